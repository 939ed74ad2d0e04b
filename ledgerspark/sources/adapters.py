"""Adapters: what the driver's tables stand for.

``txn_lineitem``: lineitem x orders x supplier. user = o_custkey, date =
l_shipdate, amount = l_extendedprice, category = 16-value list at
l_partkey % 16, merchant = s_name. users = customer, income =
60000 + 3 * c_acctbal. ``as_of`` 2001-06-30. Monthly operators.

``txn_events``: events. id = event_id, user = user_id, date = ts, amount =
value, category by event_type, merchant = ``M`` + props.k. users = distinct
user ids, income = 3000 + 10 * (user_id % 150). ``as_of`` 2024-01-31. Daily
operators, anomalies, row-ordered pages (event_id is a unique row id).

Both keep every row; ``as_of`` sets the report month and the start of recent spans.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import category_by_index, literal_map

LINEITEM_AS_OF = dt.date(2001, 6, 30)
EVENTS_AS_OF = dt.date(2024, 1, 31)

# Event type -> category of the events adapter.
EVENT_CATEGORY = [
    ("view", "Food"),
    ("click", "Transport"),
    ("signup", "Entertainment"),
    ("purchase", "Shopping"),
    ("error", "Travel"),
]


@dataclass
class Ledger:
    """A transactions fact table, its users dimension and the report date."""

    txn: DataFrame
    users: DataFrame
    as_of: dt.date


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _supplier_names(spark: SparkSession, sf_dir: str, key: Column) -> tuple[DataFrame, Column]:
    """One name per supplier, and the condition that joins it to ``key``.

    As the keys are grouped, Catalyst knows them to be unique and leaves the left
    join out of every query that reads no merchant.
    """
    supplier = _read(spark, sf_dir, "supplier").groupBy("s_suppkey").agg(F.min("s_name").alias("s_name"))
    return supplier, key == supplier.s_suppkey


def txn_lineitem(spark: SparkSession, sf_dir: str) -> Ledger:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    )
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # lineitem x orders is a large equi-join (sort-merge, or broadcast when AQE
    # measures a small side); supplier is a dimension, AQE decides the same way.
    j = li.join(orders, li.l_orderkey == orders.o_orderkey).join(
        *_supplier_names(spark, sf_dir, li.l_suppkey), "left"
    )
    txn = j.select(
        # surrogate row id; the source has no unique key of its own
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                   "l_extendedprice").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("amount"),
        category_by_index(F.col("l_partkey") % 16).alias("category"),
        F.col("s_name").alias("merchant"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("predicted_category"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )
    users = _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("customer"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("full_name"),
        (F.lit(60000.0) + F.lit(3.0) * F.col("c_acctbal")).alias("monthly_income"),
        F.lit(S.DEFAULT_CURRENCY).alias("currency"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    return Ledger(txn, users, LINEITEM_AS_OF)


def txn_events(spark: SparkSession, sf_dir: str) -> Ledger:
    ev = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    txn = ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("amount"),
        F.coalesce(literal_map(EVENT_CATEGORY)[F.col("event_type")], F.lit("Other")).alias("category"),
        F.concat(F.lit("M"), F.get_json_object("props", "$.k")).alias("merchant"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("predicted_category"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    # distinct user ids: a partial (map-side) aggregate, then one shuffle
    users = ev.select("user_id").distinct().select(
        F.col("user_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("full_name"),
        (F.lit(3000.0) + F.lit(10.0) * (F.col("user_id") % 150)).alias("monthly_income"),
        F.lit(S.DEFAULT_CURRENCY).alias("currency"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    return Ledger(txn, users, EVENTS_AS_OF)


ADAPTERS = {"lineitem": txn_lineitem, "events": txn_events}


def raw_upload_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw upload (all strings) built from the whole lineitem table, one
    upload batch per order: lines shipped
    after ``as_of`` are future-dated uploads and make their batch fail."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey).join(
        *_supplier_names(spark, sf_dir, li.l_suppkey), "left"
    )
    return j.select(
        F.col("l_orderkey").cast("string").alias("batch_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.col("l_extendedprice").cast("string").alias("amount"),
        category_by_index(F.col("l_partkey") % 16).alias("category"),
        F.col("s_name").alias("merchant"),
        F.lit(None).cast("string").alias("description"),
    )
