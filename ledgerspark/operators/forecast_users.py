"""One forecast model per user (ops I11-I13): the reference fits one person's series,
here every user's series gets its own fit, all users at once.

* **Ridge** (``UserRidge``): X'X and X'y of every user's train rows are sums in one
  grouped aggregate (partial sums before the shuffle); each Arrow batch of users is solved
  in one stacked linear solve. No user's rows are gathered.
* **Seasonal** (``UserSeasonal``): trend with changepoints under a Laplace prior, so
  that few of them bend it, and weekly, monthly and (above 365 days) yearly
  terms under a normal prior. The most probable coefficients are found down an L1 path:
  the terms with normal priors are eliminated in closed form, and the changepoints follow by
  coordinate descent from a penalty that keeps none to the prior's. Bands hold
  the residual spread, the uncertainty of the fitted terms, and trend changes to come
  at the rate and size of those seen. A user's series has at most one row a calendar
  day, so one group is small; it is fitted in ``applyInArrow``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import features as FE

# The fits travel to the Python workers by value: executors need no copy of the package on
# their path. What they use of other modules is named here.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
MONTH = (S.MONTHLY_PERIOD_DAYS, S.MONTHLY_FOURIER_ORDER)
CHANGEPOINT_SCALE, SEASON_SCALE = S.CHANGEPOINT_PRIOR_SCALE, S.SEASONALITY_PRIOR_SCALE

BAND_Z = 1.2815515655446004  # 80 % of a normal distribution lie within so many deviations
CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8  # public defaults of additive seasonal models
TREND_PRIOR_SCALE = 5.0  # of slope and offset
PATH_STEPS, SIGMA_ROUNDS = 8, 4


# ------------------------------------------------------------------ ridge ----


class UserRidge:
    """A table of one row per user: coef (in ``features`` order), intercept, rmse, mape, n_train, n_test."""

    def __init__(self, table: DataFrame, features: list[str]):
        self.table, self.features = table, features

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (one user's feature rows beside another's) with ``prediction``."""
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        terms = F.zip_with("_coef", x, lambda a, b: a * b)
        got = rows.join(self.table.select("user_id", F.col("coef").alias("_coef"), F.col("intercept").alias("_intercept")), "user_id")
        return got.withColumn("prediction", F.aggregate(terms, F.col("_intercept"), lambda s, t: s + t)).drop("_coef", "_intercept")

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, features: list[str] | None = None) -> UserRidge:
        return cls(spark.read.parquet(path), features or FE.FORECAST_FEATURES)


def _solve(p: int, alpha: float):
    """Stacked sums of users -> coefficients and intercepts. A row holds n, the p + 1
    sums, and the upper triangle of products, of the features and y."""
    upper = np.triu_indices(p + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, 1 + (p + 1) + len(upper[0]))
            n, total = v[:, 0], v[:, 1 : p + 2]
            products = np.zeros((len(v), p + 1, p + 1))
            products[:, upper[0], upper[1]] = products[:, upper[1], upper[0]] = v[:, p + 2 :]
            mean = total / n[:, None]
            centred = products - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
            coef = np.linalg.solve(centred[:, :p, :p] + alpha * np.eye(p), centred[:, :p, p:])[:, :, 0]
            intercept = mean[:, p] - (coef * mean[:, :p]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("user_id"), pa.array(list(coef), pa.list_(pa.float64())), pa.array(intercept), pa.array(n.astype(np.int64))],
                names=["user_id", "coef", "intercept", "n_train"])

    return run


def ridge_coefficients(train: DataFrame, features: list[str], alpha: float) -> DataFrame:
    """user_id, coef, intercept, n_train: each user's ridge with a free intercept."""
    cols = [F.col(c).cast("double") for c in features] + [F.col("y").cast("double")]
    # taken from the user's means, which keeps the sums small; slopes do not change
    means = train.groupBy("user_id").agg(F.array(*[F.avg(c) for c in cols]).alias("_mean"))
    moved = train.join(means, "user_id").select("user_id", *[(c - F.col("_mean")[i]).alias(f"x{i}") for i, c in enumerate(cols)], "_mean")
    x = [F.col(f"x{i}") for i in range(len(cols))]
    sums = [F.count(F.lit(1)).cast("double"), *[F.sum(c) for c in x], *[F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]]
    per = moved.groupBy("user_id").agg(F.array(*sums).alias("sums"))
    user = f"user_id {train.schema['user_id'].dataType.simpleString()}"
    got = per.mapInArrow(_solve(len(features), alpha), f"{user}, coef array<double>, intercept double, n_train long")
    back = F.aggregate(F.zip_with("coef", F.slice("_mean", 1, len(features)), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return got.join(means, "user_id").select(
        "user_id", "coef", (F.col("intercept") + F.element_at("_mean", -1) - back).alias("intercept"), "n_train")


def holdout_metrics(scored: DataFrame) -> DataFrame:
    """D12 per user: rmse, mape and the number of rows; ``scored`` has y and prediction."""
    err = F.col("prediction") - F.col("y")
    eps = F.lit(float(np.finfo(float).eps))
    return scored.groupBy("user_id").agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), (F.avg(F.abs(err) / F.greatest(F.abs("y"), eps)) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n_test"),
    )


def fit_ridge_per_user(frame: DataFrame, alpha: float = S.FORECAST_RIDGE_ALPHA) -> UserRidge:
    """I11 on a frame of E10 (``user_id, ds, y``, features, ``is_train``). A user with a
    single usable row has no train part by the split; the row itself is it then."""
    features = FE.FORECAST_FEATURES
    rows = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    frame = frame.withColumn("is_train", F.col("is_train") | (rows == 1))
    coef = ridge_coefficients(frame.where("is_train"), features, alpha)
    scored = UserRidge(coef, features).transform(frame.where(~F.col("is_train")))
    table = coef.join(holdout_metrics(scored), "user_id", "left").fillna({"rmse": 0.0, "mape": 0.0, "n_test": 0})
    return UserRidge(table, features)


# --------------------------------------------------------------- seasonal ----


def design(t: np.ndarray, span: float, changes: np.ndarray, yearly: bool) -> tuple[np.ndarray, np.ndarray]:
    """(columns with normal priors: slope, offset, sines and cosines; one hinge a changepoint) of days ``t``."""
    s = t / span
    terms = [(7.0, 3), MONTH] + ([(365.25, 10)] if yearly else [])
    k = np.concatenate([np.arange(1, order + 1) for _, order in terms])
    at = 2 * np.pi * k * t[:, None] / np.repeat([period for period, _ in terms], [order for _, order in terms])
    x = np.empty((len(t), 2 + 2 * len(k)))
    x[:, 0], x[:, 1], x[:, 2::2], x[:, 3::2] = s, 1.0, np.sin(at), np.cos(at)
    return x, np.maximum(0.0, s[:, None] - changes[None, :])


def l1_path(gram: np.ndarray, target: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """argmin d'Gd/2 - t'd + penalty |d|_1 by coordinate descent, down from the penalty
    that keeps nothing (or on from ``start``)."""
    d = np.zeros(len(target)) if start is None else start.copy()
    scale = np.diag(gram)
    usable = scale > 1e-12
    most = float(np.abs(target).max(initial=0.0))
    levels = np.geomspace(most, penalty, PATH_STEPS) if start is None and most > penalty > 0 else [penalty]
    for level in levels:
        slope = target - gram @ d
        for _ in range(100):  # the terms that are in, or want in
            active = np.flatnonzero(usable & ((d != 0) | (np.abs(slope) > level * (1 + 1e-9))))
            largest = 0.0
            for _ in range(200):
                moved = 0.0
                for j in active.tolist():
                    free = slope[j] + scale[j] * d[j]
                    step = (np.sign(free) * max(abs(free) - level, 0.0)) / scale[j] - d[j]
                    if step:
                        d[j] += step
                        slope -= step * gram[:, j]
                        moved = max(moved, abs(step))
                largest = max(largest, moved)
                if moved < 1e-7:
                    break
            if largest < 1e-7:
                break
    return d


def _raised(gram: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``gram`` with ``by`` added to its diagonal."""
    out = gram.copy()
    out.flat[:: len(gram) + 1] += by
    return out


def _inverse(gram: np.ndarray, least: float) -> np.ndarray:
    """Inverse of a symmetric matrix with no eigenvalue below ``least``; by eigenvalues, the
    slower way, only where rounding could hide the smallest."""
    if least > 1e-10 * np.trace(gram):
        return np.linalg.inv(gram)
    return np.linalg.pinv(gram, hermitian=True)


class SeasonalFit:
    """The most probable trend, seasons and changepoints of one series (days ``t`` from 0, values ``y``)."""

    def __init__(self, t: np.ndarray, y: np.ndarray, n_changepoints: int = CHANGEPOINTS):
        n = len(t)
        self.span, self.scale = max(float(t[-1]), 1.0), float(np.abs(y).max()) or 1.0
        count = min(n_changepoints, max(0, int(CHANGEPOINT_RANGE * n) - 1))
        # spread over the first part of the history, as days of the series
        at = np.linspace(0, int(CHANGEPOINT_RANGE * n) - 1, count + 1).round().astype(int)[1:] if count else np.empty(0, int)
        self.changes = t[at] / self.span
        self.yearly = n > 365
        x, h = design(t, self.span, self.changes, self.yearly)
        z = y / self.scale
        prior = np.full(x.shape[1], SEASON_SCALE ** -2.0)
        prior[:2] = TREND_PRIOR_SCALE**-2
        variance, delta = max(float(z.var()), 1e-10), None
        full = np.hstack((x, h))
        products, p = full.T @ full, x.shape[1]
        xx, xh, hh, hz = products[:p, :p], products[:p, p:], products[p:, p:], h.T @ z
        sides = np.column_stack((xh, x.T @ z))
        # a changepoint that was not kept is uncertain, too
        ridge = np.concatenate((prior, np.full(h.shape[1], 1 / (2 * CHANGEPOINT_SCALE**2))))
        for _ in range(SIGMA_ROUNDS):  # noise and coefficients in turn
            solved = np.linalg.solve(_raised(xx, variance * prior), sides)
            gram, target = hh - xh.T @ solved[:, :-1], hz - xh.T @ solved[:, -1]
            delta = l1_path(gram, target, variance / CHANGEPOINT_SCALE, delta)
            beta = solved[:, -1] - solved[:, :-1] @ delta
            rest = z - x @ beta - h @ delta
            kept = delta != 0
            inverse = _inverse(_raised(products, variance * ridge), variance * ridge.min())
            # terms that the data decide take away degrees of freedom: the trace of ``inverse @ products``
            used = float(np.einsum("ij,ji->", inverse, products))
            variance = max(float(rest @ rest) / max(n - used, 1.0), 1e-10)
        self.beta, self.delta, self.kept, self.variance, self.inverse = beta, delta, kept, variance, inverse

    def predict(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean, standard deviation) on days ``t``."""
        x, h = design(t, self.span, self.changes, self.yearly)
        full = np.hstack((x, h))
        fitted = np.einsum("ij,ij->i", full @ self.inverse, full)
        ahead = np.maximum(t / self.span - 1.0, 0.0)
        size = float(np.abs(self.delta).mean()) if len(self.delta) else 0.0
        # changes to come: as many per time as changepoints, Laplace of that size, anywhere ahead
        trend = len(self.delta) * 2 * size**2 * ahead**3 / 3
        spread = np.sqrt(self.variance * (1.0 + fitted) + trend)
        return (x @ self.beta + h @ self.delta) * self.scale, spread * self.scale


SEASONAL_TABLE = ("last_ds date, n_days long, changepoints long, sigma double, rmse double, mape double, n_test long, "
                  "covered double, mean array<double>, spread array<double>")  # fmt: skip


_FITTED = pa.schema([
    ("last_ds", pa.date32()), ("n_days", pa.int64()), ("changepoints", pa.int64()), ("sigma", pa.float64()), ("rmse", pa.float64()),
    ("mape", pa.float64()), ("n_test", pa.int64()), ("covered", pa.float64()), ("mean", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64())),
])


def fit_series(ds: np.ndarray, y: np.ndarray, horizon: int, days: int) -> dict | None:
    """Holdout metrics of the fit on the train part (E10), and ``days`` forecasts of the fit on
    all days, after the last one. ``ds``: dates in order. None for fewer than 2 days."""
    n = len(y)
    if n < 2:
        return None
    ds = np.asarray(ds, "datetime64[D]")
    t = np.where(np.isnat(ds), np.nan, (ds - ds[0]).astype(float))  # a day without a date is an error, not a far one
    split = max(n - horizon, int(n * 0.8))
    out = {"rmse": 0.0, "mape": 0.0, "n_test": n - split, "covered": None}
    if 2 <= split < n:
        mean, spread = SeasonalFit(t[:split], y[:split]).predict(t[split:])
        err = mean - y[split:]
        out["rmse"] = float(np.sqrt((err**2).mean()))
        out["mape"] = float((np.abs(err) / np.maximum(np.abs(y[split:]), np.finfo(float).eps)).mean() * 100)
        out["covered"] = float((np.abs(err) <= BAND_Z * spread).mean())
    fit = SeasonalFit(t, y)
    mean, spread = fit.predict(t[-1] + np.arange(1, days + 1))
    return {**out, "last_ds": ds[-1].item(), "n_days": n, "changepoints": int(fit.kept.sum()), "sigma": float(np.sqrt(fit.variance) * fit.scale),
            "mean": mean.tolist(), "spread": spread.tolist()}


class UserSeasonal:
    """A table of one row per user: holdout metrics and the forecasts of the days after the last one."""

    def __init__(self, table: DataFrame):
        self.table = table

    def points(self, days: int) -> DataFrame:
        """user_id, model_used, date, predicted_amount, lower_bound, upper_bound; all at least 0, 2 dp."""
        def money(c: Column) -> Column:
            return F.round(F.greatest(c, F.lit(0.0)), 2)

        each = F.posexplode(F.slice(F.arrays_zip("mean", "spread"), 1, days))
        m, s = F.col("p.mean"), F.col("p.spread") * F.lit(BAND_Z)
        return self.table.select("user_id", "last_ds", each.alias("k", "p")).select(
            "user_id", F.lit("seasonal").alias("model_used"), F.date_add("last_ds", F.col("k") + 1).alias("date"),
            money(m).alias("predicted_amount"), money(m - s).alias("lower_bound"), money(m + s).alias("upper_bound"))

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> UserSeasonal:
        return cls(spark.read.parquet(path))


def fit_seasonal_per_user(daily: DataFrame, horizon: int = S.FORECAST_DEFAULT_DAYS, days: int = S.FORECAST_MAX_DAYS) -> UserSeasonal:
    """I12 for every user of ``daily`` (``user_id, ds, y``; one row a day). Users with fewer
    than 2 days have no row."""
    schema = f"user_id {daily.schema['user_id'].dataType.simpleString()}, {SEASONAL_TABLE}"

    def fit(series: pa.Table) -> pa.Table:
        ds = series.column("ds").to_numpy()
        order = np.argsort(ds, kind="stable")
        got = fit_series(ds[order], series.column("y").to_numpy().astype(float)[order], horizon, days)
        fields = [series.schema.field("user_id"), *_FITTED]
        cols = [series.column("user_id").slice(0, 1 if got else 0).combine_chunks(), *(pa.array([got[f.name]] if got else [], f.type) for f in _FITTED)]
        return pa.Table.from_arrays(cols, schema=pa.schema(fields))

    return UserSeasonal(daily.select("user_id", "ds", F.col("y").cast("double").alias("y")).groupBy("user_id").applyInArrow(fit, schema))


def without_model(txn_days: DataFrame, table: DataFrame, days: int) -> DataFrame:
    """I14 for users without a fitted model: zeros after their last day. ``txn_days``: user_id, last_date."""
    alone = txn_days.join(table.select("user_id"), "user_id", "left_anti")
    zero = F.lit(0.0)
    return alone.select("user_id", F.lit("Insufficient Data").alias("model_used"),
                        F.explode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", days))).alias("date"),
                        zero.alias("predicted_amount"), zero.alias("lower_bound"), zero.alias("upper_bound"))


def pooled(table: DataFrame) -> dict:
    """Holdout RMSE and MAPE over all users' rows, from the users' own."""
    n = F.col("n_test")
    r = table.agg(F.sum(n).alias("n"), F.sqrt(F.sum(n * F.col("rmse") ** 2) / F.sum(n)).alias("rmse"),
                  (F.sum(n * F.col("mape")) / F.sum(n)).alias("mape")).first()
    return {"forecast_rmse": round(float(r["rmse"] or 0.0), 2), "forecast_mape": round(float(r["mape"] or 0.0), 2), "test_days": int(r["n"] or 0)}
