"""Evaluation metrics (ops D10-D13) as aggregates.

The confusion matrix is a grouped count (classes x classes rows, bounded by
the label set), so it is the only thing brought to the driver. AUC has two
exact forms: the rank form over a distributed running count (``auc_rank``)
and Spark's evaluator with ``numBins=0`` (used inside model training).
``count_before`` is also the distributed numbering used for new user ids and
for the merchant index.
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction)."""
    return scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class_metrics(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 when undefined."""
    tp = cm.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    support = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    classes = support.select("cls").unionByName(predicted.select("cls")).distinct()
    j = (
        classes.join(tp, "cls", "left")
        .join(support, "cls", "left")
        .join(predicted, "cls", "left")
        .na.fill(0, ["tp", "support", "predicted"])
    )
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(
        (F.col("precision") + F.col("recall")) > 0,
        F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
    ).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1).select("cls", "precision", "recall", "f1", "support", "tp")


def classification_summary(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy (sum of true positives over all rows) and
    macro F1 (mean over the classes present in labels or predictions)."""
    per = per_class_metrics(confusion_matrix(scored, label, prediction))
    return per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
    )


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> dict:
    r = classification_summary(scored, label, prediction).first()
    return {"accuracy": round(float(r["accuracy"] or 0.0), 4), "f1_macro": round(float(r["f1_macro"] or 0.0), 4)}


def binary_summary(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """D10 binary: accuracy, precision, recall, F1 of the positive class."""
    g = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when((F.col(label) == 1) & (F.col(prediction) == 1), 1)).alias("tp"),
        F.count(F.when((F.col(label) == 0) & (F.col(prediction) == 1), 1)).alias("fp"),
        F.count(F.when((F.col(label) == 1) & (F.col(prediction) == 0), 1)).alias("fn"),
        F.count(F.when(F.col(label) == F.col(prediction), 1)).alias("correct"),
    )
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    g = g.withColumns({"accuracy": F.col("correct") / F.col("n"), "precision": p, "recall": r})
    f1 = F.when(
        F.col("precision") + F.col("recall") > 0,
        F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
    ).otherwise(F.lit(0.0))
    return g.withColumn("f1", f1)


def count_before(per: DataFrame, order_col: str, count_col: str, parts: int | None = None) -> DataFrame:
    """Exclusive running total of ``count_col`` in ``order_col`` order (any
    sortable type), without a single-partition window. The rows are
    range-partitioned on the order column and checkpointed, which fixes
    each row's range for good (a recomputed task sees the same ranges);
    each range sums its own rows in one task, and the per-range totals (one
    row per range, a proven bound) give every range its offset. Equal keys
    always fall in the same range."""
    from ..session import reliable_checkpoint

    spark = per.sparkSession
    n = max(1, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = reliable_checkpoint(per.repartitionByRange(n, order_col))
    r = ranged.withColumn("_pid", F.spark_partition_id())
    w_local = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = r.withColumn("_local", F.coalesce(F.sum(count_col).over(w_local), F.lit(0)))
    totals = r.groupBy("_pid").agg(F.sum(count_col).alias("_tot"))
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(w_off), F.lit(0)).alias("_off"))
    return (
        local.join(F.broadcast(offsets), "_pid")
        .withColumn("before", (F.col("_off") + F.col("_local")).cast("long"))
        .drop("_pid", "_local", "_off")
    )


def auc_rank(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC by the rank form with average ranks for ties:
    (sum of positive ranks - p(p+1)/2) / (p n); 0.5 when one class is
    missing. Twice the rank sum is an integer, summed exactly as bigint."""
    per = scored.groupBy(F.col(score).alias("s")).agg(
        F.count(F.lit(1)).alias("cnt"), F.count(F.when(F.col(label) == 1, 1)).alias("pos")
    )
    ranked = count_before(per, "s", "cnt")
    # average rank of a tie group = before + (cnt + 1) / 2; doubled to stay integral
    g = ranked.agg(
        F.sum(F.col("pos") * (F.lit(2) * F.col("before") + F.col("cnt") + F.lit(1))).alias("rank_sum2"),
        F.sum("pos").alias("p"),
        F.sum("cnt").alias("n_all"),
    )
    n_neg = F.col("n_all") - F.col("p")
    auc = F.when(
        (F.col("p") > 0) & (n_neg > 0),
        (F.col("rank_sum2") - F.col("p") * (F.col("p") + F.lit(1))).cast("double")
        / (F.lit(2) * F.col("p") * n_neg).cast("double"),
    ).otherwise(F.lit(0.5))
    return g.select(auc.alias("auc"))


def binary_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score") -> dict:
    r = binary_summary(scored, label, prediction).first()
    labels = scored.select(label).distinct().count()
    if labels < 2:
        auc = 0.5
    else:
        ev = BinaryClassificationEvaluator(
            rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0
        )
        auc = float(ev.evaluate(scored.select(F.col(label).cast("double").alias(label), score)))
    return {
        "accuracy": round(float(r["accuracy"] or 0.0), 4),
        "precision": round(float(r["precision"]), 4),
        "recall": round(float(r["recall"]), 4),
        "f1": round(float(r["f1"]), 4),
        "auc": round(auc, 4),
    }


def regression_metrics(scored: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """RMSE and MAPE (x 100) on a holdout; MAPE divides by
    ``max(|y|, eps)`` like scikit-learn."""
    eps = 2.220446049250313e-16
    err = F.col(prediction) - F.col(label)
    return scored.agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(err) / F.greatest(F.abs(F.col(label)), F.lit(eps))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    )


def class_balance_frame(frame: DataFrame, label: str) -> DataFrame:
    """Class counts and the positive rate."""
    return frame.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_balance_summary(frame: DataFrame, label: str) -> DataFrame:
    """Rows, positives, negatives, classes, minority count (0 with a single
    class) and positive rate at 4 dp (0 without rows), in one aggregate."""
    pos = F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))
    one = frame.agg(F.count(label).alias("n"), pos.alias("positives"))
    both = (F.col("positives") > 0).cast("int") + (F.col("negatives") > 0).cast("int")
    return one.withColumn("negatives", F.col("n") - F.col("positives")).select(
        "n", "positives", "negatives", both.cast("long").alias("n_classes"),
        F.when(both == 2, F.least("positives", "negatives")).otherwise(F.lit(0)).cast("long").alias("minority"),
        F.when(F.col("n") > 0, F.round(F.col("positives") / F.col("n"), 4)).otherwise(F.lit(0.0)).alias("positive_rate"),
    )
