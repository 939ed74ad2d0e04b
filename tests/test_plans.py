"""Structural checks on the physical plans of the registered queries:
no Python UDF, no cartesian product or nested-loop join, top-k per user
with a partial group limit before the shuffle, filters pushed into the scan."""

import pytest

import __spark_entry__ as E

SQL_KEYS = sorted(E.oracle_sql())
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def _plan(spark, name, sf):
    df = E.queries()[name](spark, sf)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SQL_KEYS)
def test_no_udf_no_cross_join(spark, sf_small, name):
    plan = _plan(spark, name, sf_small)
    for node in FORBIDDEN:
        assert node not in plan, f"{name} plans a {node}"


@pytest.mark.parametrize("name", ["f1_list_page", "d3_top_merchants", "d19_daily_trend", "j5_anomaly"])
def test_top_k_has_partial_group_limit(spark, sf_small, name):
    plan = _plan(spark, name, sf_small)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_month_filter_reaches_the_scan(spark, sf_small):
    plan = _plan(spark, "d1_month_summary", sf_small)
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line and "lineitem" in line][0]
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan


def test_scans_read_only_needed_columns(spark, sf_small):
    plan = _plan(spark, "d1_month_summary", sf_small)
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line and "lineitem" in line][0]
    assert "l_partkey" not in scan and "l_quantity" not in scan and "l_discount" not in scan


@pytest.mark.parametrize("name", ["d1_month_summary", "d4_monthly_features", "g2_distinct_values"])
def test_distinct_counts_expand_no_rows(spark, sf_small, name):
    assert "Expand" not in _plan(spark, name, sf_small)


def test_supplier_is_joined_only_where_merchants_are_read(spark, sf_small):
    assert "s_suppkey" not in _plan(spark, "d1_month_summary", sf_small)
    assert "s_suppkey" in _plan(spark, "d3_top_merchants", sf_small)


def test_explanations_exchange_little(spark, sf_small):
    """The rollup and the users are written bucketed by user: without a single broadcast,
    fewer than ten exchanges remain (most of them of the anomaly rule, on raw rows)."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _plan(spark, "k1_explanation_figures", sf_small).count("Exchange hashpartitioning") < 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
