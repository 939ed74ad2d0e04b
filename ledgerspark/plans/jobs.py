"""Assembled jobs (ops I16-I19, J7 with model inputs, K10).

Each job is one Spark application over the whole tables: features are
shared parents, model outputs are DataFrames keyed by ``user_id`` and every
report is a set of joins on ``user_id``. Nested per-user records are built
with ``collect_list`` only over bounded lists (<= 60 forecast points, 10
predictions, <= 18 recommendations per user).
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import explain as K
from ..operators import forecast as FC
from ..operators import models as M
from ..operators import rules as J
from ..operators import features as FE
from ..sources.files import merge_metrics, scratch_path


@dataclass
class Models:
    category: M.CategoryModel | None = None
    risk: M.RiskModel | None = None
    forecast: FC.ForecastModel | None = None
    metrics: dict | None = None


def train_all(
    txn: DataFrame,
    users: DataFrame,
    num_trees: int = 200,
    risk_iters: int = 150,
    folds: int = 5,
    forecast_model: str = "ridge",
) -> Models:
    """I16: features -> three fits -> merged metrics (G3, later keys win)."""
    t0 = time.time()
    cat = M.fit_category_model(txn, num_trees=num_trees, folds=folds)
    risk = M.fit_risk_model(txn, users, max_iter=risk_iters)
    fc = FC.fit_forecaster(txn, model=forecast_model)
    facts = txn.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    income = users.agg(F.avg("monthly_income").alias("a")).first()["a"]
    metrics = merge_metrics(
        cat.metrics,
        risk.metrics,
        fc.metrics,
        {
            "mean_monthly_income": round(float(income or 0.0), 2),
            "total_transactions": int(facts),
            "training_time_seconds": round(time.time() - t0, 2),
        },
    )
    return Models(cat, risk, fc, metrics)


def model_metrics_view(spark: SparkSession, metrics: dict | None) -> DataFrame:
    """Six headline metrics, 0 when missing (RMSE/MAPE may be NULL)."""
    m = metrics or {}
    row = (
        float(m.get("classifier_accuracy", 0) or 0),
        float(m.get("classifier_f1_macro", 0) or 0),
        float(m.get("risk_auc_roc", 0) or 0),
        float(m.get("risk_f1", 0) or 0),
        None if m.get("forecast_rmse") is None else float(m["forecast_rmse"]),
        None if m.get("forecast_mape") is None else float(m["forecast_mape"]),
    )
    return spark.createDataFrame(
        [row],
        "classifier_accuracy double, classifier_f1 double, risk_auc_roc double, risk_f1 double, "
        "forecast_rmse double, forecast_mape double",
    )


def model_outputs(txn: DataFrame, users: DataFrame, models: Models | None, days: int = S.FORECAST_DEFAULT_DAYS):
    """Risk and forecast frames per user; heuristic values (I18) for any
    missing model."""
    h_risk, h_fc = J.heuristic_inputs(users, days)
    risk = M.risk_score(models.risk, txn, users) if models and models.risk else h_risk
    if models and models.forecast and models.forecast.kind == "ridge":
        pts = FC.forecast_points(models.forecast, txn, users, days)
        fc = FC.forecast_summary(pts, models.forecast, days).join(users.select("user_id", "monthly_income"), "user_id")
    elif models and models.forecast and models.forecast.kind == "seasonal":
        pts = FC.seasonal_points_per_user(models.forecast, txn, days)
        fc = FC.forecast_summary(pts, models.forecast, days).join(users.select("user_id", "monthly_income"), "user_id")
    else:
        pts = None
        fc = h_fc.withColumns({"model_used": F.lit("unknown"), "rmse": F.lit(None).cast("double")})
    return risk, fc, pts


def by_user(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table bucketed and sorted by user: aggregates,
    windows and joins per user find their rows together, without an exchange. ``df`` has a
    bounded number of rows a user."""
    spark = df.sparkSession
    name = f"ledgerspark_by_user_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(buckets, "user_id")  # a bucket a task
    rows.write.option("path", scratch_path(spark, name)).bucketBy(buckets, "user_id").sortBy("user_id").saveAsTable(name)
    return spark.table(name)


def shared_rollup(txn: DataFrame) -> DataFrame:
    """The job's one daily rollup (``by_user``): every rule and explanation reads it, the fact
    table is scanned once for them, and a lost executor rereads it."""
    return by_user(FE.daily_rollup(txn))


def recommendation_job(txn: DataFrame, users: DataFrame, as_of: dt.date, models: Models | None = None,
                       rollup: DataFrame | None = None) -> DataFrame:
    """J7 with model inputs when given (heuristic mode otherwise)."""
    risk, fc, _ = model_outputs(txn, users, models)
    r = rollup if rollup is not None else shared_rollup(txn)
    return J.recommendations(J.all_rules(txn, users, as_of, risk, fc, rollup=r))


def explanation_figures_job(txn: DataFrame, users: DataFrame, as_of: dt.date, models: Models | None = None,
                            mode: str = "reference") -> DataFrame:
    """K1 + the figures of K2-K8 for every recommendation of J7."""
    users = by_user(users)
    risk, fc, _ = model_outputs(txn, users, models)
    r = shared_rollup(txn)
    recs = J.recommendations(J.all_rules(txn, users, as_of, risk, fc, rollup=r))
    return K.explanation_figures(recs, txn, users, as_of, risk, fc, mode, rollup=r)


def explanation_job(txn: DataFrame, users: DataFrame, as_of: dt.date, models: Models | None = None,
                    mode: str = "reference") -> DataFrame:
    """K1-K9 per recommendation, with the model inputs of J7."""
    figs = explanation_figures_job(txn, users, as_of, models, mode)
    return K.explain(figs, models.risk.importances if models and models.risk else None)


def explain_report(txn: DataFrame, users: DataFrame, as_of: dt.date, models: Models | None = None) -> DataFrame:
    """Explanations + numeric metrics (H24) + global importances."""
    ex = explanation_job(txn, users, as_of, models)
    glob = None
    if models and models.category and models.risk:
        both = [("classifier_" + f, round(float(v), 4)) for f, v in models.category.importances] + [
            ("risk_" + f, round(float(v), 4)) for f, v in models.risk.importances
        ]
        glob = sorted(both, key=lambda x: -x[1])[:20]
    return K.explain_report(ex, models.metrics if models else None, glob)


def prediction_report(txn: DataFrame, users: DataFrame, models: Models, days: int = S.FORECAST_DEFAULT_DAYS) -> DataFrame:
    """Per user, the last ten category predictions (F6), the risk
    record (I10) and the forecast record (I13/I14)."""
    FC._check_days(days)
    preds = M.last_ten_predictions(M.predict_category(models.category, M.last_rows(txn)))
    cat = preds.groupBy("user_id").agg(
        F.array_sort(
            F.collect_list(F.struct("transaction_id", "id", "predicted_category", F.round("confidence", 4).alias("confidence")))
        ).alias("category_predictions")
    )
    risk, fc, pts = model_outputs(txn, users, models, days)
    risk_rec = risk.select(
        "user_id",
        F.struct("overspend_probability", "risk_level", "days_remaining", "current_spending", "projected_spending",
                 "monthly_income").alias("risk"),
    )
    if pts is not None:
        plist = pts.groupBy("user_id").agg(
            F.array_sort(F.collect_list(F.struct("date", "predicted_amount", "lower_bound", "upper_bound"))).alias("forecast")
        )
        fc_rec = fc.join(plist, "user_id").select(
            "user_id",
            F.struct("forecast", "total_predicted", "forecast_days", "model_used", "rmse", "mape").alias("forecast"),
        )
    else:
        fc_rec = fc.select("user_id", F.struct("total_predicted", "forecast_days").alias("forecast"))
    active = txn.select("user_id").distinct()  # users without rows get no report (404 in the reference)
    return active.join(cat, "user_id", "left").join(risk_rec, "user_id", "left").join(fc_rec, "user_id", "left")
