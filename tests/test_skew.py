"""A hot key holding a third of all rows: results stay whole and AQE splits
the hot partition of the row-level joins (thresholds lowered to test size)."""

import pytest
from pyspark.sql import functions as F

from ledgerspark import schemas as S
from ledgerspark.operators import features as FE
from ledgerspark.operators import rules as J

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _skewed_txn(spark, n=60000):
    # user 1 / Food holds a third of the rows; the rest spread over 2000 users
    return spark.range(0, n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 2000 + 2).cast("long").alias("user_id"),
        F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 150).cast("int")).alias("date"),
        (F.round((F.col("id") * 7919) % 10000 / 100.0 + 1, 2)).alias("amount"),
        F.when(F.col("id") % 3 == 0, F.lit("Food")).otherwise(
            F.element_at(F.array(*[F.lit(c) for c in S.CATEGORIES]), (F.col("id") % 16 + 1).cast("int"))
        ).alias("category"),
        F.lit("M").alias("merchant"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("predicted_category"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


def test_hot_key_is_salted_and_results_whole(spark, skew_conf):
    txn = _skewed_txn(spark)
    plain = FE.group_stats_on_rows(txn)
    spark.conf.set("spark.ledgerspark.hotGroupRows", "3000")  # user 1 / Food: 20000 rows -> 7 buckets
    try:
        salted = FE.group_stats_on_rows(txn)
        cols = ["id", "user_id", "category", "cat_mean", "cat_std", "cat_count"]
        assert salted.count() == txn.count()  # every row kept, none dropped
        assert salted.select(*cols).exceptAll(plain.select(*cols)).count() == 0
        assert plain.select(*cols).exceptAll(salted.select(*cols)).count() == 0
        # the hot group's rows meet its statistics in 7 join buckets, not one
        from ledgerspark.operators.skew import join_back  # noqa: F401

        hot_rows = txn.filter("user_id = 1 AND category = 'Food'").count()
        assert hot_rows == 20000
        sizes = (
            salted.filter("user_id = 1 AND category = 'Food'")
            .groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
        assert len(sizes) >= 4 and max(r["count"] for r in sizes) <= hot_rows / 2
    finally:
        spark.conf.unset("spark.ledgerspark.hotGroupRows")


def test_salted_join_back_helper(spark):
    from ledgerspark.operators.skew import join_back

    rows = spark.range(0, 1000).select((F.col("id") % 2).alias("k"), F.col("id"))
    agg = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = join_back(rows, agg, ["k"], "n", hot_rows=100)
    assert out.count() == 1000 and out.filter("n != 500").count() == 0
    left = join_back(rows, agg.filter("k = 0"), ["k"], "n", how="left", hot_rows=100)
    assert left.count() == 1000 and left.filter("n IS NULL").count() == 500


def test_anomaly_rule_on_hot_key(spark, skew_conf):
    txn = _skewed_txn(spark)
    spike = spark.createDataFrame(
        [(10**9, 1, "2025-02-01", 100000.0, "Food")], "id long, user_id long, date string, amount double, category string"
    ).select(
        "id", "user_id", F.col("date").cast("date").alias("date"), "amount", "category", F.lit("M").alias("merchant"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("predicted_category"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    hits = J.rule_anomaly(txn.unionByName(spike)).filter("user_id = 1").collect()
    assert [h.amount for h in hits] == [100000.0]


def test_salted_anti_join(spark):
    from ledgerspark.operators.skew import anti_join

    rows = spark.range(0, 3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id") % 7 + 2).alias("user_id"),
                                       F.col("id"))
    drop = spark.createDataFrame([(1,), (3,), (99,)], "user_id long")
    got = anti_join(rows, drop, ["user_id"], hot_rows=100)
    exp = rows.join(drop, "user_id", "left_anti")
    assert got.count() == exp.count() and got.exceptAll(exp.select(*got.columns)).count() == 0
