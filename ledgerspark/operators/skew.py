"""Joining per-key aggregates back to raw rows when one key is hot.

A grouped aggregate is skew-safe (map-side partial aggregation), but
joining it back to the raw rows is not: all rows of a hot key meet in one
task. AQE's skew-join split does not apply here, because one side of the
join is an aggregate sitting on its own shuffle. So hot keys are salted
explicitly:

* hot groups are those with more than ``hot_rows`` rows. At most
  (all rows / ``hot_rows``) groups can be hot, a proven bound, so their
  list is broadcast;
* each raw row gets a salt from a hash of its own columns, modulo its
  group's number of buckets, ``ceil(rows / hot_rows)`` (1 for a cold group),
  through a map-side broadcast join;
* only the hot groups' aggregate rows are replicated, once per salt;
* the join runs on key + salt, so a hot group is spread over that many
  tasks. Every row still meets its one aggregate row; results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_HOT_ROWS = 1_000_000
HOT_ROWS_CONF = "spark.ledgerspark.hotGroupRows"


def hot_rows_setting(df: DataFrame) -> int:
    """Rows per task above which a group is split (session setting)."""
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def join_back(
    rows: DataFrame,
    agg: DataFrame,
    keys: list[str],
    count_col: str,
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """``rows`` joined to ``agg`` (one row per key, ``count_col`` = rows of
    the key) on ``keys``, with hot keys salted as described above."""
    limit = hot_rows or hot_rows_setting(rows)
    buckets = F.ceil(F.col(count_col) / F.lit(float(limit))).cast("int")
    hot = agg.filter(F.col(count_col) > F.lit(limit)).select(*keys, buckets.alias("_buckets"))
    salted_rows = rows.join(hot, keys, "left").withColumn(
        "_salt",
        F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce(F.col("_buckets"), F.lit(1))),
    ).drop("_buckets")
    salted_agg = agg.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_buckets"), F.lit(1)) - F.lit(1)))
    ).drop("_buckets")
    return salted_rows.join(salted_agg, [*keys, "_salt"], how).drop("_salt")


def anti_join(rows: DataFrame, keys_df: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """``rows`` without the keys listed in ``keys_df`` (left anti join), with
    a hot key's rows spread over several tasks: the keys to drop carry the
    number of rows they have in ``rows`` (a map-side combined count), and the
    anti join runs through ``join_back``."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    marked = counts.join(keys_df.select(*keys).distinct(), keys, "left_semi")
    return join_back(rows, marked, keys, "_rows", how="left_anti", hot_rows=hot_rows)
