"""Summaries and listings (ops D1-D3, D14, D17-D19, F1, F7, G2).

Aggregates use bigint cents (``money_sum``): exact, order-independent and
cheap inside codegen, with partial (map-side) aggregation before the one
shuffle on the group key. Top-k per user is ``row_number() <= k``, which
Spark plans as a partial ``WindowGroupLimit`` before the exchange, so a hot
user sends at most k rows per map task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import category_bits, cents, day_bits, distinct_bits, js_round, month_start, month_text
from .filters import by_month


def _month_of(as_of: dt.date, year: int | None, month: int | None) -> tuple[int, int]:
    return (year or as_of.year, month or as_of.month)


def month_totals(txn: DataFrame) -> DataFrame:
    """Per user and present month: exact total, row count, active days."""
    return txn.groupBy("user_id", month_start("date").alias("year_month")).agg(
        F.sum(cents("amount")).alias("total_cents"),
        F.count(F.lit(1)).alias("transaction_count"),
        distinct_bits(day_bits()).alias("active_days"),
    )


def month_summary(
    txn: DataFrame,
    users: DataFrame,
    as_of: dt.date,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """Per user, the month's total, row count, days with spending and the
    daily average (total / days with spending). Users without rows get the
    zero row. Quotients stay unrounded; ``present_summary`` rounds."""
    y, m = _month_of(as_of, year, month)
    agg = by_month(txn, y, m).groupBy("user_id").agg(
        F.sum(cents("amount")).alias("total_cents"),
        F.count(F.lit(1)).alias("transaction_count"),
        distinct_bits(day_bits()).alias("active_days"),
    )
    total = F.coalesce(F.col("total_cents"), F.lit(0)) / F.lit(100.0)
    return users.select("user_id").join(agg, "user_id", "left").select(
        "user_id",
        F.lit(f"{y}-{m:02d}").alias("month"),
        total.alias("total_spending"),
        F.coalesce(F.col("transaction_count"), F.lit(0)).alias("transaction_count"),
        F.coalesce(F.col("active_days"), F.lit(0)).alias("active_days"),
        F.coalesce(
            (F.col("total_cents") / F.lit(100.0)) / F.greatest(F.col("active_days"), F.lit(1)),
            F.lit(0.0),
        ).alias("daily_average"),
    )


def monthly_summaries(txn: DataFrame) -> DataFrame:
    """D1 over every present user-month (the batch form of the summary)."""
    t = month_totals(txn)
    total = F.col("total_cents") / F.lit(100.0)
    return t.select(
        "user_id",
        month_text("year_month").alias("month"),
        total.alias("total_spending"),
        "transaction_count",
        "active_days",
        (total / F.col("active_days")).alias("daily_average"),
    )


def category_breakdown(
    txn: DataFrame, as_of: dt.date, year: int | None = None, month: int | None = None
) -> DataFrame:
    """D2 (flat form): per user, category -> month total."""
    y, m = _month_of(as_of, year, month)
    return (
        by_month(txn, y, m)
        .groupBy("user_id", "category")
        .agg((F.sum(cents("amount")) / F.lit(100.0)).alias("total"))
    )


def category_breakdown_map(breakdown: DataFrame) -> DataFrame:
    """D2 (map form): one ``map<category, total>`` per user; at most 16 keys."""
    return breakdown.groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "total")))).alias(
            "category_breakdown"
        )
    )


def top_merchants(
    txn: DataFrame,
    as_of: dt.date,
    year: int | None = None,
    month: int | None = None,
    k: int = S.TOP_MERCHANTS,
) -> DataFrame:
    """D3: per user, the k merchants with the largest month total; NULL and
    empty merchants are left out; ties broken by merchant name."""
    y, m = _month_of(as_of, year, month)
    per = (
        by_month(txn, y, m)
        .filter(F.col("merchant").isNotNull() & (F.col("merchant") != ""))
        .groupBy("user_id", "merchant")
        .agg(F.sum(cents("amount")).alias("amount_cents"))
    )
    w = Window.partitionBy("user_id").orderBy(F.col("amount_cents").desc(), F.col("merchant"))
    return (
        per.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("user_id", "rank", "merchant", (F.col("amount_cents") / F.lit(100.0)).alias("amount"))
    )


def present_summary(summary: DataFrame, breakdown: DataFrame, merchants: DataFrame) -> DataFrame:
    """The nested summary record per user: totals rounded to 2 dp, category
    map and top-merchant list (both bounded: 16 keys, k entries)."""
    cats = category_breakdown_map(breakdown.withColumn("total", F.round("total", 2)))
    tops = merchants.groupBy("user_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "merchant", "amount"))),
            lambda s: F.struct(s["merchant"].alias("merchant"), F.round(s["amount"], 2).alias("amount")),
        ).alias("top_merchants")
    )
    return (
        summary.join(cats, "user_id", "left")
        .join(tops, "user_id", "left")
        .select(
            "user_id",
            F.round("total_spending", 2).alias("total_spending"),
            "transaction_count",
            F.coalesce("category_breakdown", F.create_map().cast("map<string,double>")).alias(
                "category_breakdown"
            ),
            F.round("daily_average", 2).alias("daily_average"),
            F.coalesce(
                "top_merchants",
                F.array().cast("array<struct<merchant:string,amount:double>>"),
            ).alias("top_merchants"),
            "month",
        )
    )


def dataset_profile(txn: DataFrame) -> DataFrame:
    """One row: rows, distinct categories and merchants, date range."""
    return txn.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("category").alias("n_categories"),
        F.countDistinct("merchant").alias("n_merchants"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def rows_per_category(txn: DataFrame) -> DataFrame:
    """Rows per category, largest first (ties by name)."""
    return txn.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(
        F.col("n_rows").desc(), "category"
    )


def dashboard_cards(summary: DataFrame, users: DataFrame) -> DataFrame:
    """Total, count, daily average and percent of income remaining."""
    return summary.join(users.select("user_id", "monthly_income"), "user_id").select(
        "user_id",
        "month",
        "total_spending",
        "transaction_count",
        "daily_average",
        "monthly_income",
        ((F.lit(1.0) - F.col("total_spending") / F.col("monthly_income")) * 100).alias(
            "pct_income_remaining"
        ),
    )


def category_share(breakdown: DataFrame) -> DataFrame:
    """Category values rounded to whole units, largest first, each with
    its share (percent) of the rounded total. Bounded: 16 rows per user."""
    v = breakdown.select("user_id", "category", js_round("total").alias("value"))
    w_all = Window.partitionBy("user_id")
    w_rank = Window.partitionBy("user_id").orderBy(F.col("value").desc(), F.col("category"))
    return v.select(
        "user_id",
        "category",
        "value",
        (F.col("value") / F.sum("value").over(w_all) * 100).alias("share_pct"),
        F.row_number().over(w_rank).alias("rank"),
    )


def list_page(
    txn: DataFrame,
    skip: int = 0,
    limit: int = S.LIST_DEFAULT_LIMIT,
    user_id: int | None = None,
) -> DataFrame:
    """rows by date descending (ties: id descending), ``skip`` then
    ``limit``. With ``user_id`` it is one sorted page (TakeOrderedAndProject);
    without, every user's page at once (``row_number`` with a group limit)."""
    if skip < 0 or not (1 <= limit <= S.LIST_MAX_LIMIT):
        raise ValueError("skip must be >= 0 and limit in 1..500")
    order = [F.col("date").desc(), F.col("id").desc()]
    if user_id is not None:
        return (
            txn.filter(F.col("user_id") == F.lit(user_id))
            .orderBy(*order)
            .offset(skip)
            .limit(limit)
        )
    w = Window.partitionBy("user_id").orderBy(*order)
    return (
        txn.withColumn("row_no", F.row_number().over(w))
        .filter(F.col("row_no") <= skip + limit)
        .filter(F.col("row_no") > skip)
    )


def daily_trend(txn: DataFrame, latest: int = 50, days: int = 30) -> DataFrame:
    """D19 (F7): per user, the latest ``latest`` rows, summed per date,
    rounded to whole units, the last ``days`` dates in ascending order."""
    page = list_page(txn, 0, latest)
    per_day = page.groupBy("user_id", "date").agg(
        (F.sum(cents("amount")) / F.lit(100.0)).alias("total")
    )
    w = Window.partitionBy("user_id").orderBy(F.col("date").desc())
    return (
        per_day.withColumn("k", F.row_number().over(w))
        .filter(F.col("k") <= days)
        .select("user_id", "date", js_round("total").alias("amount"))
    )


def distinct_values(txn: DataFrame) -> DataFrame:
    """Per user, distinct categories, months and days: bitmaps of days and categories
    per month, combined before the shuffle, then one row a month."""
    bits = txn.groupBy("user_id", month_start("date").alias("_month")).agg(
        F.bit_or(category_bits()).alias("_categories"), F.bit_or(day_bits()).alias("_days")
    )
    return bits.groupBy("user_id").agg(
        distinct_bits(F.col("_categories")).alias("n_categories"),
        F.count("_month").alias("n_months"),
        F.coalesce(F.sum(F.bit_count(F.col("_days"))), F.lit(0)).cast("long").alias("n_days"),
    )
