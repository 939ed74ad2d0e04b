"""Models on ``pyspark.ml`` (ops I1, I3-I10, I5, I6, F4, F5, F8, D13).

* I1: merchant index, alphabetical, unseen/NULL -> ``Unknown`` [Q7], kept as
  a distributed table (no label list on the driver).
* I3/I4: 16-class category model. Boosted trees in Spark are binary only
  and one-vs-rest returns no probability, so a random forest is used
  (multi-class with probabilities), grown on histograms (``forest``).
* I7/I10: overspend-risk model, boosted trees by the rules of
  ``GBTClassifier`` with a positive-class weight, grown on histograms
  (``boosting``); a one-class training set gets the constant model (I9),
  decided before fitting.
* I5: stratified k folds by a hash of the row id (no ``rand``), fits per
  fold, out-of-fold scores unioned.

Training sets and their folds are checkpointed into the shared checkpoint
folder before the iterative fits, so a lost executor recomputes from the
checkpoint, not from the raw scan. Large ones are dealt to all cores: a
pass of a tree fit computes far more per byte than the scans that AQE sizes
partitions for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import default_if_blank, risk_level
from ..session import reliable_checkpoint
from . import features as FE
from .boosting import HistogramBoost
from .forest import HistogramForest

UNKNOWN = "Unknown"

#: Rows of a training set below which a partition is not divided further.
ROWS_PER_TASK = 20_000


# --------------------------------------------------------------- I1 --------

@dataclass
class MerchantIndex:
    """Alphabetical label ids of the merchants seen in training, as a
    table (merchant, merchant_encoded). ``n_labels`` and ``unknown_id`` are
    the two scalars the transform needs (Q7)."""

    table: DataFrame
    n_labels: int
    unknown_id: float | None

    @property
    def labels(self) -> list:  # small frames only (tests, inspection)
        return [r[0] for r in self.table.orderBy("merchant_encoded").select("merchant").collect()]

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "MerchantIndex":
        return _index_from_table(spark.read.parquet(path))


def _index_from_table(table: DataFrame) -> MerchantIndex:
    r = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("merchant") == UNKNOWN, F.col("merchant_encoded"))).alias("u"),
    ).first()
    return MerchantIndex(table, int(r["n"]), None if r["u"] is None else float(r["u"]))


def fit_merchant_index(frame: DataFrame, col: str = "merchant") -> MerchantIndex:
    """Distinct merchants (NULL/empty -> ``Unknown`` first) numbered in
    alphabetical order by a distributed running count; the label list
    never passes through the driver. The table is checkpointed."""
    from .metrics import count_before

    labels = frame.select(default_if_blank(col, UNKNOWN).alias("merchant")).distinct().withColumn("_one", F.lit(1))
    ranked = count_before(labels, "merchant", "_one")
    table = reliable_checkpoint(ranked.select("merchant", F.col("before").cast("double").alias("merchant_encoded")))
    return _index_from_table(table)


def apply_merchant_index(index: MerchantIndex, df: DataFrame, col: str = "merchant") -> DataFrame:
    """C5 + Q7: a join to the label table; merchants not seen in training take
    ``Unknown``'s id when ``Unknown`` was seen, otherwise the id n
    (``Unknown`` appended after the fitted labels). The join is an equi-join
    on the merchant (broadcast when AQE measures the table small; a hot
    merchant's partition is split by the skew join otherwise)."""
    fallback = index.unknown_id if index.unknown_id is not None else float(index.n_labels)
    m = df.withColumn("merchant_clean", default_if_blank(col, UNKNOWN))
    t = index.table.select(F.col("merchant").alias("merchant_clean"), F.col("merchant_encoded").alias("_enc"))
    return (
        m.join(t, "merchant_clean", "left")
        .withColumn("merchant_encoded", F.coalesce(F.col("_enc"), F.lit(fallback)))
        .drop("_enc", "merchant_clean")
    )


# --------------------------------------------------------------- I5 --------

def assign_folds(df: DataFrame, label: str, k: int, id_col: str = "id", seed: int = 42,
                 exact: bool = False) -> DataFrame:
    """Fold of every row, seeded by a hash of the row id (no ``rand``).

    ``exact=False``: fold = hash modulo k. Every label is spread evenly in
    expectation, with no sort or shuffle (used for the row-level category
    model). ``exact=True``: shuffled stratified folds as in the reference.
    Rows are ordered by (label, hash), numbered by the distributed running
    count, and dealt round-robin within each label, so fold sizes of a
    label differ by at most one (used for the smaller user-month risk
    frame). Neither form uses a window over a whole label."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    if not exact:
        return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))
    from .metrics import count_before

    x = df.withColumn("_ord", F.struct(F.col(label).alias("l"), h.alias("h"), F.col(id_col).alias("i"))).withColumn(
        "_one", F.lit(1)
    )
    ranked = count_before(x, "_ord", "_one")
    starts = ranked.groupBy(label).agg(F.min("before").alias("_start"))  # one row per label
    return (
        ranked.join(F.broadcast(starts), label)
        .withColumn("fold", ((F.col("before") - F.col("_start")) % F.lit(k)).cast("int"))
        .drop("_ord", "_one", "before", "_start")
    )


def dealt_to_cores(train: DataFrame, rows: int) -> DataFrame:
    """``train`` in as many partitions as there are cores, where its rows are worth it."""
    parts = min(train.sparkSession.sparkContext.defaultParallelism, rows // ROWS_PER_TASK)
    return train.repartition(parts) if parts > train.rdd.getNumPartitions() else train


def fit_concurrently(pipe: Pipeline, frames: list, parallelism: int) -> list:
    """Fit one pipeline on several frames as concurrent Spark jobs (the fold
    fits and the final fit are independent), like ``CrossValidator``'s
    ``parallelism``: on small data the idle cores run other fits, on a
    cluster the jobs share the executors. Boosted trees grow together, a
    level of all fits a job."""
    from concurrent.futures import ThreadPoolExecutor

    stages = pipe.getStages()
    if len(stages) == 1 and isinstance(stages[0], HistogramBoost):
        return [PipelineModel([m]) for m in stages[0].fit_together(frames)]
    if parallelism <= 1 or len(frames) <= 1:
        return [pipe.fit(f) for f in frames]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(frames))) as pool:
        # one copy per fit: each thread gets its own JVM estimator objects
        return list(pool.map(lambda f: pipe.copy().fit(f), frames))


# ---------------------------------------------------------- I3 / I4 --------

@dataclass
class CategoryModel:
    pipeline: PipelineModel
    merchant_index: MerchantIndex
    metrics: dict = field(default_factory=dict)
    importances: list = field(default_factory=list)


def _category_pipeline(num_trees: int, max_depth: int, seed: int) -> Pipeline:
    label_idx = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc")
    forest = HistogramForest(S.CLASSIFIER_FEATURES, num_trees, max_depth, seed, rate=0.8, share=0.8, min_rows=3)
    return Pipeline(stages=[label_idx, forest])


def category_training_frame(txn: DataFrame, merchant_index: MerchantIndex) -> DataFrame:
    from .filters import null_defaults

    f = FE.transaction_features(null_defaults(txn))
    return apply_merchant_index(merchant_index, f)


def fit_category_model(
    txn: DataFrame,
    num_trees: int = 200,
    max_depth: int = 6,
    folds: int = 0,
    seed: int = 42,
    parallelism: int = 6,
) -> CategoryModel:
    """I3 (+ I5, D10): fit on all rows; with ``folds`` >= 2 also out-of-fold
    accuracy and macro F1."""
    from .filters import null_defaults
    from .metrics import classification_metrics

    mi = fit_merchant_index(null_defaults(txn))
    train = reliable_checkpoint(category_training_frame(txn, mi).select("id", "category", *S.CLASSIFIER_FEATURES))
    pipe = _category_pipeline(num_trees, max_depth, seed)
    metrics = {}
    rows = train.count()
    fr = reliable_checkpoint(assign_folds(train, "category", folds, exact=True)) if folds >= 2 else None
    ks = list(range(folds)) if fr is not None else []
    frames = [fr.filter(F.col("fold") != k) for k in ks] + [train]
    fitted = fit_concurrently(pipe, [dealt_to_cores(f, rows) for f in frames], parallelism)
    model = fitted[-1]
    if ks:
        oof = None
        for k, m in zip(ks, fitted):
            p = m.transform(fr.filter(F.col("fold") == k)).select("label", "prediction")
            oof = p if oof is None else oof.unionByName(p)
        cm = classification_metrics(reliable_checkpoint(oof))  # several passes
        metrics = {
            "classifier_accuracy": cm["accuracy"],
            "classifier_f1_macro": cm["f1_macro"],
        }
    n_classes = len(model.stages[0].labels)
    metrics.update(
        {"n_classes": n_classes, "n_samples": rows, "n_features": len(S.CLASSIFIER_FEATURES)}
    )
    importances = sorted(zip(S.CLASSIFIER_FEATURES, model.stages[-1].importances), key=lambda x: -x[1])
    return CategoryModel(model, mi, metrics, importances)


def predict_category(cm: CategoryModel, txn: DataFrame) -> DataFrame:
    """I4: predicted category and its probability per row."""
    f = category_training_frame(txn, cm.merchant_index)
    p = cm.pipeline.transform(f)
    to_label = IndexToString(inputCol="prediction", outputCol="predicted_category",
                             labels=cm.pipeline.stages[0].labels)
    p = to_label.transform(p)
    return p.select(
        "id",
        "user_id",
        "date",
        "amount",
        "category",
        "predicted_category",
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def with_predicted_category(cm: CategoryModel, txn: DataFrame) -> DataFrame:
    """Q12: the transactions with ``predicted_category`` filled by the
    category model (one pass: a transform, no join back)."""
    f = apply_merchant_index(cm.merchant_index, FE.transaction_features(txn)).withColumnRenamed(
        "predicted_category", "_stored_prediction"
    )
    p = IndexToString(inputCol="prediction", outputCol="predicted_category",
                      labels=cm.pipeline.stages[0].labels).transform(cm.pipeline.transform(f))
    return p.select(*[c for c in txn.columns])


def last_rows(txn: DataFrame, n: int = 10) -> DataFrame:
    """The last n rows of each user by (date, id); a partial group limit runs before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.col("date").desc(), F.col("id").desc())
    return txn.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def last_ten_predictions(pred: DataFrame, n: int = 10) -> DataFrame:
    """per user, the predictions of the last n rows by (date, id),
    numbered 1..n in date order (position), with the real row id too [Q8]."""
    last = last_rows(pred, n)
    w_asc = Window.partitionBy("user_id").orderBy("date", "id")
    return last.withColumn("transaction_id", F.row_number().over(w_asc))


# ---------------------------------------------------------- I7-I10 ---------

@dataclass
class RiskModel:
    pipeline: PipelineModel | None
    constant_class: int | None
    features: list
    metrics: dict = field(default_factory=dict)
    importances: list = field(default_factory=list)


def class_balance(frame: DataFrame, label: str = "is_overspend") -> dict:
    """Rows, positives, minority count and positive rate (4 dp) in one
    aggregate."""
    r = frame.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(label), F.lit(0)).alias("pos"),
    ).first()
    n, pos = int(r["n"]), int(r["pos"])
    neg = n - pos
    return {
        "n": n,
        "positives": pos,
        "negatives": neg,
        "n_classes": int(pos > 0) + int(neg > 0),
        "minority": min(pos, neg) if pos > 0 and neg > 0 else 0,
        "overspend_rate": round(pos / n, 4) if n else 0.0,
    }


def evaluation_plan(n: int, minority: int, n_classes: int) -> tuple[str, int]:
    """I8: folds ``min(5, max(2, n // 3))``; k-fold when n >= 6 and the
    minority has at least that many rows; else a stratified 70/30 split
    when n >= 4 and both classes exist; else no evaluation."""
    folds = min(5, max(2, n // 3))
    if n_classes < 2:
        return "constant", 0
    if n >= 6 and minority >= folds:
        return "kfold", folds
    if n >= 4 and minority >= 1:
        return "split", 0
    return "none", 0


def _risk_pipeline(features: list, max_iter: int, seed: int) -> Pipeline:
    boost = HistogramBoost(features, "is_overspend", "weight", max_iter, 4, seed, step=0.1, rate=0.8, share=0.8, min_rows=5)
    return Pipeline(stages=[boost])


def risk_training_frame(txn: DataFrame, users: DataFrame, exclude: list | None = None) -> DataFrame:
    from .filters import fill_feature_nulls

    feats = [c for c in FE.RISK_FEATURES if c not in (exclude or [])]
    m = FE.risk_features(txn, users)
    m = fill_feature_nulls(m, feats)
    # positive-class weight 2.0 (class imbalance)
    return m.withColumn("weight", F.when(F.col("is_overspend") == 1, F.lit(2.0)).otherwise(F.lit(1.0)))


def fit_risk_model(
    txn: DataFrame,
    users: DataFrame,
    max_iter: int = 150,
    seed: int = 42,
    exclude: list | None = None,
    parallelism: int = 6,
) -> RiskModel:
    """I7 + I8 + I9 (+ D10, D11): evaluation by plan, then the final fit."""
    from .metrics import binary_metrics

    feats = [c for c in FE.RISK_FEATURES if c not in (exclude or [])]
    frame = reliable_checkpoint(
        risk_training_frame(txn, users, exclude).select(
            F.xxhash64("user_id", "year_month").alias("id"), "is_overspend", "weight", *feats
        )
    )
    bal = class_balance(frame)
    plan, folds = evaluation_plan(bal["n"], bal["minority"], bal["n_classes"])
    base = {"n_months": bal["n"], "overspend_rate": bal["overspend_rate"]}
    if plan == "constant":
        majority = 1 if bal["positives"] > 0 else 0
        metrics = {
            "risk_accuracy": 1.0, "risk_f1": 0.0, "risk_precision": 0.0, "risk_recall": 0.0,
            "risk_auc_roc": 0.5, **base,
        }
        return RiskModel(None, majority, feats, metrics, [(f, 0.0) for f in feats])
    pipe = _risk_pipeline(feats, max_iter, seed)
    scored = None
    if plan == "kfold":
        fr = reliable_checkpoint(assign_folds(frame, "is_overspend", folds, exact=True))
        trains = [fr.filter(F.col("fold") != k) for k in range(folds)]
        tests = [fr.filter(F.col("fold") == k) for k in range(folds)]
    elif plan == "split":
        fr = reliable_checkpoint(assign_folds(frame, "is_overspend", 10, exact=True))
        trains, tests = [fr.filter(F.col("fold") >= 3)], [fr.filter(F.col("fold") < 3)]
    else:
        trains, tests = [], []
    fitted = fit_concurrently(pipe, trains + [frame], parallelism)
    model = fitted[-1]
    for m, t in zip(fitted, tests):
        p = m.transform(t)
        scored = p if scored is None else scored.unionByName(p)
    if scored is not None:
        s = reliable_checkpoint(scored.select(  # several passes below
            F.col("is_overspend").alias("label"),
            "prediction",
            vector_to_array("probability")[1].alias("score"),
        ))
        bm = binary_metrics(s)
        metrics = {
            "risk_accuracy": bm["accuracy"], "risk_f1": bm["f1"], "risk_precision": bm["precision"],
            "risk_recall": bm["recall"], "risk_auc_roc": bm["auc"], **base,
        }
    else:
        metrics = {"risk_accuracy": 0.0, "risk_f1": 0.0, "risk_precision": 0.0, "risk_recall": 0.0,
                   "risk_auc_roc": 0.0, **base}
    importances = sorted(zip(feats, [round(float(x), 4) for x in model.stages[-1].importances]), key=lambda x: -x[1])
    return RiskModel(model, None, feats, metrics, importances)


def risk_score(rm: RiskModel, txn: DataFrame, users: DataFrame) -> DataFrame:
    """Latest month per user -> probability, level (H19), current and
    projected spend (2 x current, [Q10]); users with fewer than two months
    get zeros and ``low``; days_remaining is always 30."""
    from .filters import fill_feature_nulls

    latest = FE.latest_row(fill_feature_nulls(FE.risk_features(txn, users), rm.features))
    if rm.pipeline is None:
        scored = latest.withColumn("p", F.lit(float(rm.constant_class)))
    else:
        scored = rm.pipeline.transform(latest).withColumn("p", vector_to_array("probability")[1])
    s = scored.select("user_id", "p", "total_spending")
    out = users.select("user_id", "monthly_income").join(s, "user_id", "left")
    prob = F.coalesce(F.round("p", 4), F.lit(0.0))
    cur = F.coalesce(F.round("total_spending", 2), F.lit(0.0))
    return out.select(
        "user_id",
        prob.alias("overspend_probability"),
        F.when(F.col("p").isNull(), F.lit("low")).otherwise(risk_level(F.col("p"))).alias("risk_level"),
        F.lit(30).alias("days_remaining"),
        cur.alias("current_spending"),
        F.coalesce(F.round(F.col("total_spending") * (30 / max(1, 15)), 2), F.lit(0.0)).alias(
            "projected_spending"
        ),
        "monthly_income",
    )


# ------------------------------------------------------- importances -------

def importance_frame(spark: SparkSession, pairs: list, prefix: str = "") -> DataFrame:
    """(feature, importance) rows, importance at 4 dp, largest first."""
    rows = [(prefix + f, round(float(v), 4)) for f, v in pairs]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def global_importances(spark: SparkSession, classifier_pairs: list, risk_pairs: list, k: int = 20) -> DataFrame:
    """both models' importances, prefixed, largest first, first k."""
    from ..functions.scalars import feature_label, strip_model_prefix

    both = importance_frame(spark, classifier_pairs, "classifier_").unionByName(
        importance_frame(spark, risk_pairs, "risk_")
    )
    top = both.orderBy(F.col("importance").desc(), "feature").limit(k)
    # H26 + H13: the label the dashboard shows (prefix stripped, title case)
    return top.withColumn("label", feature_label(strip_model_prefix("feature")))


def dashboard_importances(importances: DataFrame, k: int = 10) -> DataFrame:
    """the first ``k`` rows of F4 as the recommendations page lists them: place, name
    without the model's prefix, importance and bar width (three times the per cent, 100 at most)."""
    from ..functions.scalars import strip_model_prefix

    place = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))  # F4 holds a few rows
    return importances.select(
        place.cast("long").alias("place"), strip_model_prefix("feature").alias("name"), "importance",
        F.least(F.lit(100.0), F.col("importance") * 300).alias("bar_width"),
    ).where(F.col("place") <= k).orderBy("place")
