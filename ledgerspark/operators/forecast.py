"""Spend forecasting (ops I11-I15, D12, E10).

Every user has a model of their own (``forecast_users``); the series of all users'
spending together can be fitted as well, with ``pyspark.ml``. Features are computed
per user (E5/E6 over each user's daily series, which is
bounded by the calendar). The horizon is generated with
``explode(sequence(...))`` per user: no driver loop over days or users.

* ridge (I11): per user in closed form; over all users' spending
  ``LinearRegression`` with an L2 penalty equal to
  scikit-learn's ``alpha`` (``regParam = alpha * std(y) / n`` with the
  normal-equation solver; Spark scales the penalty by the label's spread).
* seasonal (I12): per user with sparse changepoints; over all users' spending
  additive trend with hinge changepoints and Fourier
  weekly / monthly / yearly terms, fitted by ``LinearRegression`` with L2.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import reliable_checkpoint
from . import features as FE
from . import forecast_users as FU
from .metrics import regression_metrics


@dataclass
class ForecastModel:
    kind: str  # "ridge" | "seasonal"
    pipeline: PipelineModel | FU.UserRidge | FU.UserSeasonal
    features: list
    metrics: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)


def _check_days(days: int) -> None:
    if not (S.FORECAST_MIN_DAYS <= days <= S.FORECAST_MAX_DAYS):
        raise ValueError("forecast days must be in 10..60")


def _ridge(features: list, reg: float) -> Pipeline:
    vec = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    lr = LinearRegression(
        featuresCol="features",
        labelCol="y",
        predictionCol="prediction",
        solver="normal",
        elasticNetParam=0.0,
        standardization=False,
        regParam=reg,
        fitIntercept=True,
    )
    return Pipeline(stages=[vec, lr])


def _ridge_reg(train: DataFrame, alpha: float) -> float:
    r = train.agg(F.stddev_pop("y").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    n, sd = int(r["n"] or 0), float(r["sd"] or 0.0)
    if n == 0:
        raise ValueError("no training rows after lags: need at least 8 dates")
    return alpha * sd / n if sd > 0 else 0.0


def ridge_training_frame(txn: DataFrame, horizon: int = S.FORECAST_DEFAULT_DAYS, per_user: bool = False,
                         leak_free: bool = False) -> DataFrame:
    """D7 -> E5/E6 -> drop rows with NULL lags (B6) -> E10 split."""
    daily = FE.daily_totals(txn, per_user=per_user)
    f = FE.daily_features(daily, per_user=per_user, leak_free=leak_free)
    f = f.na.drop(subset=[f"lag_{k}" for k in S.FORECAST_LAGS])
    return FE.chronological_split(f, horizon, per_user=per_user)


def fit_ridge(txn: DataFrame, horizon: int = S.FORECAST_DEFAULT_DAYS, alpha: float = S.FORECAST_RIDGE_ALPHA,
              per_user: bool = True, leak_free: bool = False) -> ForecastModel:
    """I11 (+ D12): fit on the train part, RMSE/MAPE on the holdout.

    ``per_user=True`` fits every user's daily series on its own; ``per_user=False`` fits
    the global daily series. The metrics are those of all holdout rows together; a
    user's own are in ``pipeline.table``."""
    feats = FE.FORECAST_FEATURES
    if per_user:
        frame = reliable_checkpoint(ridge_training_frame(txn, horizon, True, leak_free))
        model = FU.fit_ridge_per_user(frame, alpha)
        model.table = reliable_checkpoint(model.table)
        days = model.table.agg(F.sum("n_train")).first()[0]
        if days is None:
            raise ValueError("no training rows after lags: need at least 8 dates")
        return ForecastModel("ridge", model, feats, {**FU.pooled(model.table), "model_type": "regression_fallback", "training_days": int(days)})
    frame = ridge_training_frame(txn, horizon, per_user, leak_free).cache()
    train = frame.filter("is_train")
    model = _ridge(feats, _ridge_reg(train, alpha)).fit(train)
    test = frame.filter(~F.col("is_train"))
    r = regression_metrics(model.transform(test)).first()
    metrics = {
        "forecast_rmse": round(float(r["rmse"] or 0.0), 2),
        "forecast_mape": round(float(r["mape"] or 0.0), 2),
        "model_type": "regression_fallback",
        "training_days": train.count(),
        "test_days": int(r["n"]),
    }
    frame.unpersist()
    return ForecastModel("ridge", model, feats, metrics)


def forecast_points(fm: ForecastModel, txn: DataFrame, users: DataFrame | None = None,
                    days: int = S.FORECAST_DEFAULT_DAYS) -> DataFrame:
    """I13 + I14 (ridge): per user, ``days`` points after the user's last
    date. Features never advance over the horizon, so every day gets the
    prediction of the latest row [Q11]; band +-30 %, all >= 0, 2 dp. Users
    whose series has no row with all lags (< 8 dates) get zeros and model
    ``Insufficient Data``."""
    _check_days(days)
    daily = FE.daily_totals(txn)
    f = FE.daily_features(daily).na.drop(subset=[f"lag_{k}" for k in S.FORECAST_LAGS])
    latest = FE.latest_row(f, "ds")
    scored = fm.pipeline.transform(latest).select(
        "user_id", F.col("ds").alias("last_ds"), F.greatest(F.col("prediction"), F.lit(0.0)).alias("p")
    )
    # last transaction date per user, from the same daily aggregate (no second scan)
    last_txn = daily.groupBy("user_id").agg(F.max("ds").alias("last_date"))
    base = last_txn.join(scored, "user_id", "left")
    if users is not None:
        base = base.join(users.select("user_id"), "user_id")
    start = F.coalesce(F.col("last_ds"), F.col("last_date"))
    p = F.coalesce(F.col("p"), F.lit(0.0))
    pts = base.select(
        "user_id",
        F.when(F.col("p").isNull(), F.lit("Insufficient Data")).otherwise(F.lit("regression_fallback")).alias(
            "model_used"
        ),
        F.explode(F.sequence(F.date_add(start, 1), F.date_add(start, days))).alias("date"),
        F.round(p, 2).alias("predicted_amount"),
        F.round(p * F.lit(1.0 - S.RIDGE_BAND), 2).alias("lower_bound"),
        F.round(p * F.lit(1.0 + S.RIDGE_BAND), 2).alias("upper_bound"),
    )
    return pts


def forecast_summary(points: DataFrame, fm: ForecastModel | None = None, days: int = S.FORECAST_DEFAULT_DAYS) -> DataFrame:
    """Per user: total of the points, days, model name, the user's holdout metrics (those
    of the model where it is one for all)."""
    rmse = fm.metrics.get("forecast_rmse") if fm else None
    mape = fm.metrics.get("forecast_mape") if fm else None
    own = fm.pipeline.table if fm and isinstance(fm.pipeline, FU.UserRidge | FU.UserSeasonal) else None
    g = points.groupBy("user_id", "model_used").agg(
        F.round(F.sum("predicted_amount"), 2).alias("total_predicted"),
        F.count(F.lit(1)).alias("forecast_days"),
    )
    insufficient = F.col("model_used") == "Insufficient Data"
    if own is not None:
        zero = F.lit(0.0)
        metric = [F.when(insufficient, zero).otherwise(F.round(c, 2)).alias(c) for c in ("rmse", "mape")]
        return g.join(own.select("user_id", "rmse", "mape"), "user_id", "left").select(*g.columns, *metric)
    return g.withColumns(
        {
            "rmse": F.when(insufficient, F.lit(0.0)).otherwise(F.lit(rmse).cast("double")),
            "mape": F.when(insufficient, F.lit(0.0)).otherwise(F.lit(mape).cast("double")),
        }
    )


# ------------------------------------------------------------ seasonal -----

def _seasonal_columns(t_days, span_days: float, changepoints: list, yearly: bool) -> dict:
    """Trend, hinge and Fourier columns of day offset ``t_days``. Under one
    L2 penalty, multiplying a column group by s gives its coefficients a
    prior of scale s: hinge columns carry the changepoint prior scale,
    Fourier columns the seasonality prior scale."""
    cp_scale, season_scale = F.lit(S.CHANGEPOINT_PRIOR_SCALE), F.lit(S.SEASONALITY_PRIOR_SCALE)
    t = t_days / F.lit(max(span_days, 1.0))
    cols = {"t": t}
    for j, c in enumerate(changepoints):
        cols[f"cp_{j}"] = F.greatest(F.lit(0.0), t - F.lit(c)) * cp_scale
    terms = [("w", 7.0, 3), ("m", S.MONTHLY_PERIOD_DAYS, S.MONTHLY_FOURIER_ORDER)]
    if yearly:
        terms.append(("y", 365.25, 10))
    for name, period, order in terms:
        for k in range(1, order + 1):
            ang = t_days * F.lit(2.0 * math.pi * k / period)
            cols[f"{name}_sin_{k}"] = F.sin(ang) * season_scale
            cols[f"{name}_cos_{k}"] = F.cos(ang) * season_scale
    return cols


def fit_seasonal(txn: DataFrame, horizon: int = S.FORECAST_DEFAULT_DAYS, n_changepoints: int = 25,
                 alpha: float = 1.0) -> ForecastModel:
    """Additive trend + weekly (order 3) + monthly (30.5 d, order 5) +
    yearly (order 10, only above 365 days) over the global daily series;
    changepoints spread over the first 80 % of the history (25, 80 %, 3 and
    10 are the public defaults of additive seasonal models). The label is
    scaled by its largest absolute value and fitted by ridge with the prior
    scales folded into the columns. Evaluated on the E10 holdout, then
    refitted on all days."""
    daily = FE.daily_totals(txn, per_user=False)
    r = daily.agg(
        F.min("ds").alias("d0"), F.max("ds").alias("d1"), F.count(F.lit(1)).alias("n"),
        F.max(F.abs("y")).alias("ymax"),
    ).first()
    d0, d1, n = r["d0"], r["d1"], int(r["n"])
    if n < 2:
        raise ValueError("seasonal model needs at least 2 days")
    ymax = float(r["ymax"] or 1.0) or 1.0
    span = float((d1 - d0).days)
    k = min(n_changepoints, max(0, int(0.8 * n) - 1))
    cps = [0.8 * (j + 1) / (k + 1) for j in range(k)]
    yearly = n > 365
    t = F.datediff(F.col("ds"), F.lit(d0)).cast("double")
    cols = _seasonal_columns(t, span, cps, yearly)
    scaled = daily.withColumns(cols).withColumn("y_raw", F.col("y")).withColumn("y", F.col("y") / F.lit(ymax))
    frame = FE.chronological_split(scaled, horizon, per_user=False).cache()
    feats = list(cols)
    train = frame.filter("is_train")
    pipe = _ridge(feats, _ridge_reg(train, alpha))
    m_train = pipe.fit(train)

    def unscaled(df):
        return m_train.transform(df).withColumns(
            {"prediction": F.col("prediction") * F.lit(ymax), "y": F.col("y_raw")}
        )

    m = regression_metrics(unscaled(frame.filter(~F.col("is_train")))).first()
    resid = unscaled(train).agg(F.stddev_samp(F.col("y") - F.col("prediction")).alias("sd")).first()["sd"]
    model = _ridge(feats, _ridge_reg(frame, alpha)).fit(frame)
    metrics = {
        "forecast_rmse": round(float(m["rmse"] or 0.0), 2),
        "forecast_mape": round(float(m["mape"] or 0.0), 2),
        "model_type": "seasonal",
        "training_days": train.count(),
        "test_days": int(m["n"]),
    }
    frame.unpersist()
    extra = {"d0": d0, "d1": d1, "span": span, "changepoints": cps, "yearly": yearly,
             "resid_sd": float(resid or 0.0), "ymax": ymax}
    return ForecastModel("seasonal", model, feats, metrics, extra)


def seasonal_points(fm: ForecastModel, days: int = S.FORECAST_DEFAULT_DAYS) -> DataFrame:
    """I13 (seasonal): the ``days`` days after the last observed date of the
    global series, interval = prediction +- 1.2816 x residual deviation
    (80 %), all clipped at 0, 2 dp [Q11: starts after the last date]."""
    _check_days(days)
    from pyspark.sql import SparkSession

    ex = fm.extra
    spark = SparkSession.getActiveSession()
    horizon = spark.range(1, days + 1).select(F.date_add(F.lit(ex["d1"]), F.col("id").cast("int")).alias("ds"))
    t = F.datediff(F.col("ds"), F.lit(ex["d0"])).cast("double")
    h = horizon.withColumns(_seasonal_columns(t, ex["span"], ex["changepoints"], ex["yearly"]))
    z = 1.2816 * ex["resid_sd"]
    p = fm.pipeline.transform(h).withColumn("prediction", F.col("prediction") * F.lit(ex.get("ymax", 1.0)))
    return p.select(
        F.col("ds").alias("date"),
        F.round(F.greatest(F.col("prediction"), F.lit(0.0)), 2).alias("predicted_amount"),
        F.round(F.greatest(F.col("prediction") - F.lit(z), F.lit(0.0)), 2).alias("lower_bound"),
        F.round(F.greatest(F.col("prediction") + F.lit(z), F.lit(0.0)), 2).alias("upper_bound"),
        F.lit("seasonal").alias("model_used"),
    )


def fit_seasonal_per_user(txn: DataFrame, horizon: int = S.FORECAST_DEFAULT_DAYS) -> ForecastModel:
    """I12 for every user on their own series; ``pipeline.table`` holds a row per user."""
    model = FU.fit_seasonal_per_user(FE.daily_totals(txn), horizon)
    model.table = reliable_checkpoint(model.table)
    r = model.table.agg(F.sum(F.col("n_days") - F.col("n_test")).alias("train")).first()
    return ForecastModel("seasonal", model, [], {**FU.pooled(model.table), "model_type": "seasonal", "training_days": int(r["train"] or 0)})


def seasonal_points_per_user(fm: ForecastModel, txn: DataFrame, days: int = S.FORECAST_DEFAULT_DAYS) -> DataFrame:
    """I13 (seasonal) per user, from the user's own fit and on the user's own scale; zeros for
    users whose series is too short for one (I14)."""
    _check_days(days)
    last = txn.groupBy("user_id").agg(F.max("date").alias("last_date"))
    return fm.pipeline.points(days).unionByName(FU.without_model(last, fm.pipeline.table, days))


def fit_forecaster(txn: DataFrame, model: str = "seasonal", **kw) -> ForecastModel:
    """Explicit model choice; no silent fallback."""
    if model == "seasonal":
        return fit_seasonal_per_user(txn, **kw)
    if model == "ridge":
        return fit_ridge(txn, **kw)
    raise ValueError(f"unknown forecast model {model!r}")


def naive_holdout(txn: DataFrame, horizon: int = S.FORECAST_DEFAULT_DAYS) -> DataFrame:
    """D12 on a persistence forecast (yesterday's value, lag 1) over each
    user's E10 holdout: a baseline the fitted models are compared with."""
    daily = FE.daily_totals(txn)
    w = Window.partitionBy("user_id").orderBy("ds")
    d = daily.withColumn("prediction", F.lag("y", 1).over(w)).na.drop(subset=["prediction"])
    test = FE.chronological_split(d, horizon).filter(~F.col("is_train"))
    return test
