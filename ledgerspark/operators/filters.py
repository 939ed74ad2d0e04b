"""Projections, filters and predicates (ops B1-B9, C4).

Every filter is a plain column predicate on the fact table, so Catalyst
pushes it into the Parquet scan (``PushedFilters``) and, on a table
partitioned by month, prunes partitions. Per-user fallbacks (B3, B4) are
decided on a per-user aggregate joined back with hot users salted
(``skew.join_back``), never by a window over raw rows: a user holding a
third of all rows would otherwise land in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import after_days_before, default_if_blank, month_start


def month_bounds(year: int, month: int) -> tuple[dt.date, dt.date]:
    first = dt.date(year, month, 1)
    nxt = dt.date(year + (month == 12), month % 12 + 1, 1)
    return first, nxt


def filter_transactions(
    txn: DataFrame,
    user_id: int | None = None,
    category: str | None = None,
    start_date: dt.date | None = None,
    end_date: dt.date | None = None,
) -> DataFrame:
    """B1: optional equality on category, inclusive date bounds, user scope."""
    out = txn
    if user_id is not None:
        out = out.filter(F.col("user_id") == F.lit(user_id))
    if category:
        out = out.filter(F.col("category") == F.lit(category))
    if start_date:
        out = out.filter(F.col("date") >= F.lit(start_date))
    if end_date:
        out = out.filter(F.col("date") <= F.lit(end_date))
    return out


def by_month(txn: DataFrame, year: int, month: int) -> DataFrame:
    """B2: rows of one calendar month, written as a date range so that the
    scan gets min/max pushdown and month partitions prune."""
    first, nxt = month_bounds(year, month)
    return txn.filter((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(nxt)))


def current_or_latest_month(txn: DataFrame, as_of: dt.date) -> DataFrame:
    """Per user, rows of ``as_of``'s month; for users without any, rows of
    their latest month with data."""
    from .skew import join_back

    ym = month_start("date")
    as_of_ym = F.trunc(F.lit(as_of), "MM")
    chosen = txn.groupBy("user_id").agg(
        F.coalesce(F.max(F.when(ym == as_of_ym, ym)), F.max(ym)).alias("chosen_month"),
        F.count(F.lit(1)).alias("_rows"),
    )
    return (
        join_back(txn, chosen, ["user_id"], "_rows")
        .filter(month_start("date") == F.col("chosen_month"))
        .drop("_rows")
    )


def recent_or_all(txn: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Rows of the last ``days`` days; users with none keep all rows."""
    from .skew import join_back

    recent = after_days_before("date", as_of, days)
    flags = txn.groupBy("user_id").agg(
        F.max(recent.cast("int")).alias("has_recent"), F.count(F.lit(1)).alias("_rows")
    )
    return (
        join_back(txn, flags, ["user_id"], "_rows")
        .filter((F.col("has_recent") == 0) | recent)
        .drop("has_recent", "_rows")
    )


def recent_windows(txn: DataFrame, as_of: dt.date) -> DataFrame:
    """Per user, spend and row counts of the last 30 and the last 7 days."""
    from ..functions.scalars import cents

    r30 = after_days_before("date", as_of, 30)
    r7 = after_days_before("date", as_of, 7)
    return txn.groupBy("user_id").agg(
        (F.coalesce(F.sum(F.when(r30, cents("amount"))), F.lit(0)) / F.lit(100.0)).alias("spend_30d"),
        F.count(F.when(r30, 1)).alias("rows_30d"),
        (F.coalesce(F.sum(F.when(r7, cents("amount"))), F.lit(0)) / F.lit(100.0)).alias("spend_7d"),
        F.count(F.when(r7, 1)).alias("rows_7d"),
    )


def drop_incomplete_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (all columns when None)."""
    return df.na.drop(subset=subset) if subset else df.na.drop()


def project_transaction_out(txn: DataFrame) -> DataFrame:
    """Output columns of a transaction."""
    return txn.select(*S.TRANSACTION_OUT_COLUMNS)


def null_defaults(txn: DataFrame) -> DataFrame:
    """B8 (A5 frame): merchant NULL/empty -> ``Unknown``, description -> empty."""
    return txn.select(
        "user_id",
        "id",
        "date",
        "amount",
        "category",
        default_if_blank("merchant", "Unknown").alias("merchant"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
    )


def fill_feature_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing feature columns -> 0.0, NULL numeric features -> 0."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    return df.na.fill(0, subset=columns)


def scan_user_frame(txn: DataFrame, user_id: int) -> DataFrame:
    """A5: one user's ML frame in date order; an empty result keeps its schema."""
    return null_defaults(txn.filter(F.col("user_id") == F.lit(user_id))).orderBy("date", "id")


def user_transactions(users: DataFrame, txn: DataFrame) -> DataFrame:
    """C4: transactions with their user's profile (inner join on user_id)."""
    return users.select("user_id", "email", "monthly_income", "currency").join(txn, "user_id")
