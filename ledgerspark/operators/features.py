"""Monthly, daily and per-row features (ops C1, D4-D9, D15, D16, E1-E13, I2).

Shape of the work: raw rows are aggregated first (partial + final hash
aggregate, one shuffle on the group key), and every window runs on the
aggregated frame, keyed by user. A user's monthly or daily frame is bounded
by the calendar, not by the number of rows, so a user holding a third of
the rows does not make any window task large. Frames step over *present*
rows (months and days without rows are not filled in), like the reference.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import (
    default_if_blank,
    after_days_before,
    category_bits,
    cents,
    day_of_week,
    distinct_bits,
    is_month_end,
    is_month_start,
    is_weekend,
    month_start,
)

def _w_user_month():
    return Window.partitionBy("user_id").orderBy("year_month")


def daily_rollup(txn: DataFrame) -> DataFrame:
    """The shared parent of the calendar features: one row per (user, date,
    category) with exact cents, the row count and the day's smallest row
    id. One scan and one partially-aggregated shuffle; every feature below
    that needs only sums, counts, dates or first appearances derives from
    it, and identical rollup subtrees in one plan become one reused
    exchange, so a full rules + explanations job reads the fact table once
    for all of them."""
    return txn.groupBy("user_id", "date", "category").agg(
        F.sum(cents("amount")).alias("cents"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("id").alias("min_id"),
    )


def as_rollup(df: DataFrame) -> DataFrame:
    """``df`` if it already is a daily rollup, else its rollup."""
    return df if {"cents", "n_rows", "min_id"} <= set(df.columns) else daily_rollup(df)


# ----------------------------------------------------------- monthly -------

def monthly_aggregates(txn: DataFrame, with_ratios: bool = True) -> DataFrame:
    """D4 (+ D5 fused): per user and month: sum, count, mean, max, sample std,
    distinct categories (a bitmap of the schema's) and merchants; with ``with_ratios`` the 16 category
    sums are conditional sums in the same aggregate (one shuffle for both)."""
    aggs = [
        F.sum(cents("amount")).alias("total_cents"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.max("amount").alias("max_transaction"),
        F.stddev_samp("amount").alias("std_transaction"),
        distinct_bits(category_bits()).alias("unique_categories"),
    ]
    if with_ratios:
        aggs += [
            F.sum(F.when(F.col("category") == c, cents("amount")).otherwise(F.lit(0))).alias(
                "c_" + S.ratio_column(c)
            )
            for c in S.CATEGORIES
        ]
    keys = ["user_id", "year_month"]
    by_month = txn.withColumn("year_month", month_start("date"))
    m = by_month.groupBy(*keys).agg(*aggs)
    # distinct merchants by two aggregates, each combined before its shuffle: no row is
    # expanded per distinct count; every group has rows here, too
    merchants = by_month.groupBy(*keys, "merchant").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.count("merchant").alias("unique_merchants")
    ).withColumnsRenamed({"user_id": "_user", "year_month": "_month"})
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("year_month").eqNullSafe(F.col("_month"))
    m = m.join(merchants, same).drop("_user", "_month")
    total = F.col("total_cents") / F.lit(100.0)
    cols = [
        "user_id",
        "year_month",
        "total_cents",
        total.alias("total_spending"),
        "transaction_count",
        (total / F.col("transaction_count")).alias("avg_transaction"),
        "max_transaction",
        "std_transaction",
        "unique_categories",
        "unique_merchants",
    ]
    if with_ratios:
        cols += [
            (F.col("c_" + r) / F.col("total_cents")).alias(r) for r in S.RATIO_COLUMNS
        ]
    return m.select(*cols)


def category_ratios(txn: DataFrame) -> DataFrame:
    """Month spend per category over the month total, 0-filled, fixed 16
    columns (pivot with explicit values, so the schema never depends on the
    data)."""
    p = (
        txn.groupBy("user_id", month_start("date").alias("year_month"))
        .pivot("category", S.CATEGORIES)
        .agg(F.sum(cents("amount")))
        .na.fill(0, subset=S.CATEGORIES)
    )
    tot = sum((F.col(f"`{c}`") for c in S.CATEGORIES), F.lit(0))
    return p.select(
        "user_id",
        "year_month",
        *[(F.col(f"`{c}`") / tot).alias(S.ratio_column(c)) for c in S.CATEGORIES],
    )


def monthly_join_ratios(monthly: DataFrame, ratios: DataFrame) -> DataFrame:
    """Left join of the monthly aggregate to the category ratios."""
    return monthly.join(ratios, ["user_id", "year_month"], "left")


def income_features(monthly: DataFrame, users: DataFrame) -> DataFrame:
    """D6 (+ C2): spend / income and the label ``total > 0.9 x income``."""
    return monthly.join(users.select("user_id", "monthly_income"), "user_id").withColumns(
        {
            "spending_to_income": F.col("total_spending") / F.col("monthly_income"),
            "is_overspend": (
                F.col("total_spending") > F.col("monthly_income") * F.lit(S.OVERSPEND_INCOME_SHARE)
            ).cast("int"),
        }
    )


def monthly_windows(monthly: DataFrame) -> DataFrame:
    """Previous present month, change, 3-row rolling mean and std."""
    w = _w_user_month()
    w3 = w.rowsBetween(-2, 0)
    prev = F.lag("total_spending", 1).over(w)
    return monthly.withColumns(
        {
            "prev_month_spending": prev,
            # pct_change: x / prev - 1
            "spending_change": F.try_divide(F.col("total_spending"), prev) - F.lit(1.0),
            "rolling_3m_avg": (F.sum("total_cents").over(w3) / F.lit(100.0))
            / F.count(F.lit(1)).over(w3),
            "rolling_3m_std": F.coalesce(F.stddev_samp("total_spending").over(w3), F.lit(0.0)),
        }
    )


def risk_features(txn: DataFrame, users: DataFrame, keep_first_month: bool = False) -> DataFrame:
    """The monthly risk frame, one row per user-month
    with a previous month (the first month of each user is dropped)."""
    txn = txn.withColumn("merchant", default_if_blank("merchant", "Unknown"))  # as in the reference frame (Q15)
    m = monthly_windows(income_features(monthly_aggregates(txn), users))
    if not keep_first_month:
        m = m.filter(F.col("prev_month_spending").isNotNull())
    return m


RISK_FEATURES = [
    "total_spending",
    "transaction_count",
    "avg_transaction",
    "max_transaction",
    "std_transaction",
    "unique_categories",
    "unique_merchants",
    *S.RATIO_COLUMNS,
    "spending_to_income",
    "prev_month_spending",
    "spending_change",
    "rolling_3m_avg",
    "rolling_3m_std",
]


def latest_row(df: DataFrame, order_col: str = "year_month") -> DataFrame:
    """The last row per user (bounded frames only: months or days)."""
    w = Window.partitionBy("user_id").orderBy(F.col(order_col).desc())
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")


# ------------------------------------------------------ monthly rollups ----

def month_totals(txn: DataFrame) -> DataFrame:
    """Exact month totals per user (from the daily rollup)."""
    return as_rollup(txn).groupBy("user_id", month_start("date").alias("year_month")).agg(
        F.sum("cents").alias("total_cents")
    )


def three_month_rise(txn: DataFrame) -> DataFrame:
    """Per user with >= 3 present months, whether the last three are
    strictly increasing and the change first -> last in percent."""
    m = month_totals(txn)
    w = Window.partitionBy("user_id").orderBy(F.col("year_month").desc())
    last3 = m.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 3)
    g = last3.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("k") == 3, F.col("total_cents"))).alias("first_cents"),
        F.max(F.when(F.col("k") == 2, F.col("total_cents"))).alias("mid_cents"),
        F.max(F.when(F.col("k") == 1, F.col("total_cents"))).alias("last_cents"),
    )
    first = F.col("first_cents") / F.lit(100.0)
    last = F.col("last_cents") / F.lit(100.0)
    return g.filter(F.col("n") == 3).select(
        "user_id",
        first.alias("first_total"),
        (F.col("mid_cents") / F.lit(100.0)).alias("mid_total"),
        last.alias("last_total"),
        ((F.col("first_cents") < F.col("mid_cents")) & (F.col("mid_cents") < F.col("last_cents"))).alias(
            "rising"
        ),
        ((last - first) / first * 100).alias("increase_pct"),
    )


def category_trend(txn: DataFrame) -> DataFrame:
    """Per user and category, ``increasing`` when the last of the last
    three present months exceeds 1.1 x the first (needs >= 3 months)."""
    m = as_rollup(txn).groupBy("user_id", "category", month_start("date").alias("year_month")).agg(
        F.sum("cents").alias("cents")
    )
    w = Window.partitionBy("user_id", "category").orderBy(F.col("year_month").desc())
    last3 = m.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 3)
    g = last3.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("k") == 3, F.col("cents"))).alias("first_cents"),
        F.max(F.when(F.col("k") == 1, F.col("cents"))).alias("last_cents"),
    )
    inc = (F.col("n") == 3) & (
        (F.col("last_cents") / F.lit(100.0)) > (F.col("first_cents") / F.lit(100.0)) * F.lit(1.1)
    )
    return g.select(
        "user_id", "category", F.when(inc, F.lit("increasing")).otherwise(F.lit("stable")).alias("trend")
    )


def category_stats(txn: DataFrame, users: DataFrame) -> DataFrame:
    """Per user and category: total, total / all distinct months of the
    user, share of income, trend (E9). Unrounded; the reference rounds the
    average to 2 and the share to 4 places for its texts. Totals and trend are one
    aggregate over the months of the category."""
    m = as_rollup(txn).groupBy("user_id", "category", month_start("date").alias("year_month")).agg(F.sum("cents").alias("cents"))
    w = Window.partitionBy("user_id", "category").orderBy(F.col("year_month").desc())
    k = F.col("k")
    per_cat = m.withColumn("k", F.row_number().over(w)).groupBy("user_id", "category").agg(
        F.sum("cents").alias("cents"),
        F.max(F.when(k == 3, F.col("cents"))).alias("first_cents"),
        F.max(F.when(k == 1, F.col("cents"))).alias("last_cents"),
    )
    months = (
        m.groupBy("user_id", "year_month").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_months"))
    )
    monthly_avg = (F.col("cents") / F.lit(100.0)) / F.greatest(F.col("n_months"), F.lit(1))
    # no first_cents: fewer than three months
    inc = (F.col("last_cents") / F.lit(100.0)) > (F.col("first_cents") / F.lit(100.0)) * F.lit(1.1)
    return (
        per_cat.where(F.col("category").isNotNull()).join(months, "user_id")
        .join(users.select("user_id", "monthly_income"), "user_id")
        .withColumn("trend", F.when(inc, F.lit("increasing")).otherwise(F.lit("stable")))
        .select(
            "user_id",
            "category",
            (F.col("cents") / F.lit(100.0)).alias("total"),
            monthly_avg.alias("monthly_avg"),
            (monthly_avg / F.col("monthly_income")).alias("pct_of_income"),
            "trend",
        )
    )


def savings_position(txn: DataFrame, users: DataFrame, as_of: dt.date | None, days: int = 90) -> DataFrame:
    """D8 + D15 (+ B4): monthly average over the rows of the last ``days``
    days (all rows when there are none, or when ``as_of`` is None), savings
    and savings rate. Conditional sums over the daily rollup, aggregated to
    (user, month) and then to the user."""
    ym = month_start("date")
    if as_of is None:
        recent = F.lit(True)
    else:
        recent = after_days_before("date", as_of, days)
    # two-level aggregate (user, month) -> user: exact distinct month counts
    # without the Expand of a multi-distinct aggregate
    per_month = as_rollup(txn).groupBy("user_id", ym.alias("year_month")).agg(
        F.sum(F.when(recent, F.col("cents"))).alias("rc"),
        F.coalesce(F.sum(F.when(recent, F.col("n_rows"))), F.lit(0)).alias("rn"),
        F.sum("cents").alias("ac"),
    )
    g = per_month.groupBy("user_id").agg(
        F.sum("rc").alias("recent_cents"),
        F.sum("rn").alias("recent_rows"),
        F.count(F.when(F.col("rn") > 0, 1)).alias("recent_months"),
        F.sum("ac").alias("all_cents"),
        F.count(F.lit(1)).alias("all_months"),
    )
    use_recent = F.col("recent_rows") > 0
    cents_used = F.when(use_recent, F.col("recent_cents")).otherwise(F.col("all_cents"))
    months_used = F.when(use_recent, F.col("recent_months")).otherwise(F.col("all_months"))
    monthly_avg = (cents_used / F.lit(100.0)) / F.greatest(months_used, F.lit(1))
    out = g.join(users.select("user_id", "monthly_income"), "user_id").select(
        "user_id",
        "monthly_income",
        use_recent.alias("used_recent"),
        months_used.alias("n_months"),
        monthly_avg.alias("monthly_avg"),
    )
    savings = F.col("monthly_income") - F.col("monthly_avg")
    return out.withColumns(
        {"savings": savings, "savings_rate": savings / F.col("monthly_income")}
    )


def spending_velocity(txn: DataFrame, as_of: dt.date) -> DataFrame:
    """D16 (+ B5): 30-day total, 7-day total x 4.3, accelerating flag when the
    latter exceeds 1.2 x the former and both windows have rows."""
    r30 = after_days_before("date", as_of, 30)
    r7 = after_days_before("date", as_of, 7)
    g = as_rollup(txn).groupBy("user_id").agg(
        F.sum(F.when(r30, F.col("cents"))).alias("c30"),
        F.coalesce(F.sum(F.when(r30, F.col("n_rows"))), F.lit(0)).alias("rows_30d"),
        F.sum(F.when(r7, F.col("cents"))).alias("c7"),
        F.coalesce(F.sum(F.when(r7, F.col("n_rows"))), F.lit(0)).alias("rows_7d"),
    )
    monthly_rate = F.coalesce(F.col("c30"), F.lit(0)) / F.lit(100.0)
    weekly_rate = F.coalesce(F.col("c7"), F.lit(0)) / F.lit(100.0) * F.lit(4.3)
    return g.select(
        "user_id",
        "rows_30d",
        "rows_7d",
        monthly_rate.alias("monthly_rate"),
        weekly_rate.alias("weekly_rate"),
        ((F.col("rows_30d") > 0) & (F.col("rows_7d") > 0) & (weekly_rate > monthly_rate * F.lit(1.2))).alias(
            "accelerating"
        ),
    )


# ----------------------------------------------------------- row level -----

def group_stats_on_rows(txn: DataFrame, with_first: bool = False) -> DataFrame:
    """Category mean, sample std and count beside each row (``with_first``: the
    category's first date and id, too, E13).

    Computed as a grouped aggregate joined back on (user, category) instead
    of a window over raw rows: the aggregate is partial/final (skew-safe),
    and the join back salts hot (user, category) groups (``skew.join_back``).
    """
    from .skew import join_back

    stats = txn.groupBy("user_id", "category").agg(
        (F.sum(cents("amount")) / F.lit(100.0) / F.count(F.lit(1))).alias("cat_mean"),
        F.stddev_samp("amount").alias("cat_std"),
        F.count(F.lit(1)).alias("cat_count"),
        *([F.min(F.struct("date", "id")).alias("first_seen")] if with_first else []),
    )
    return join_back(txn, stats, ["user_id", "category"], "cat_count")


def first_appearance(txn: DataFrame) -> DataFrame:
    """Per user, the order in which categories first appear (date, id)."""
    firsts = as_rollup(txn).groupBy("user_id", "category").agg(
        F.min(F.struct("date", F.col("min_id").alias("id"))).alias("first_seen")
    )
    w = Window.partitionBy("user_id").orderBy("first_seen")
    return firsts.withColumn("appearance", F.row_number().over(w)).select(
        "user_id", "category", "first_seen", "appearance"
    )


def transaction_features(txn: DataFrame) -> DataFrame:
    """I2 (date and math part): H2-H5, H9 per row. The merchant id is added
    by the fitted merchant index (``models.merchant_index``)."""
    d = F.col("date")
    return txn.withColumns(
        {
            "day_of_week": day_of_week(d),
            "day_of_month": F.dayofmonth(d),
            "month": F.month(d),
            "is_weekend": is_weekend(d),
            "is_month_start": is_month_start(d),
            "is_month_end": is_month_end(d),
            "quarter": F.quarter(d),
            "week_of_year": F.weekofyear(d),
            "log_amount": F.log1p("amount"),
            "amount_squared": F.pow("amount", 2),
        }
    )


# ------------------------------------------------------------- daily -------

def daily_totals(txn: DataFrame, per_user: bool = True) -> DataFrame:
    """Sum per date, days without rows absent. ``ds``/``y`` columns."""
    keys = ["user_id", "date"] if per_user else ["date"]
    return (
        txn.groupBy(*keys)
        .agg(F.sum(cents("amount")).alias("y_cents"))
        .select(*[k for k in keys if k != "date"], F.col("date").alias("ds"), "y_cents",
                (F.col("y_cents") / F.lit(100.0)).alias("y"))
    )


def daily_features(daily: DataFrame, per_user: bool = True, leak_free: bool = False) -> DataFrame:
    """E5, E6 + calendar columns over the daily series (rows, not calendar).

    Default keeps the reference's frames that end at the current row (the
    target leaks into the features, [Q6]); ``leak_free`` ends them at -1.
    A global series is one window partition: bounded by the number of dates.
    """
    base = Window.partitionBy("user_id").orderBy("ds") if per_user else Window.orderBy("ds")
    end = -1 if leak_free else 0
    cols = {}
    for k in S.FORECAST_WINDOWS:
        w = base.rowsBetween(-(k - 1) + end, end)
        cols[f"rolling_mean_{k}"] = (F.sum("y_cents").over(w) / F.lit(100.0)) / F.count("y_cents").over(w)
        cols[f"rolling_std_{k}"] = F.coalesce(F.stddev_samp("y").over(w), F.lit(0.0))
    cols["day_of_week"] = day_of_week("ds")
    cols["day_of_month"] = F.dayofmonth("ds")
    cols["month"] = F.month("ds")
    for lag in S.FORECAST_LAGS:
        cols[f"lag_{lag}"] = F.lag("y", lag).over(base)
    out = daily.withColumns(cols)
    if leak_free:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols if c.startswith("rolling")})
    return out


FORECAST_FEATURES = (
    [f"rolling_{s}_{k}" for k in S.FORECAST_WINDOWS for s in ("mean", "std")]
    + ["day_of_week", "day_of_month", "month"]
    + [f"lag_{k}" for k in S.FORECAST_LAGS]
)


def chronological_split(df: DataFrame, horizon: int, per_user: bool = True, order_col: str = "ds") -> DataFrame:
    """``is_train`` for the first ``max(n - h, int(0.8 n))`` rows."""
    base = Window.partitionBy("user_id") if per_user else Window.partitionBy()
    w = base.orderBy(order_col)
    n = F.count(F.lit(1)).over(base)
    split = F.greatest(n - F.lit(horizon), F.floor(n * F.lit(0.8)).cast("long"))
    return df.withColumn("is_train", F.row_number().over(w) <= split)
