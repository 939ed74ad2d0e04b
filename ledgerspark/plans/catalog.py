"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator, over the whole driver tables through the two adapters. Keys are
prefixed with the op id. Integer outputs are widened to bigint so the
schema matches the SQL side."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import scalars as H
from ..operators import features as FE
from ..operators import filters as B
from ..operators import rules as J
from ..operators import summary as D
from ..sources.adapters import txn_events, txn_lineitem

Query = Callable[[SparkSession, str], DataFrame]


def widen_ints(df: DataFrame) -> DataFrame:
    """int/short/byte -> bigint, keeping column order."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


RULE_OUT = ["user_id", "rule_no", "pos", "rule_id", "type", "priority", "confidence", "category", "amount"]


def _q(fn: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return widen_ints(fn(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


# ---------------------------------------------------------------- summaries

def d1_month_summary(spark, d):
    L = txn_lineitem(spark, d)
    return D.month_summary(L.txn, L.users, L.as_of)


def d1_monthly_summaries(spark, d):
    return D.monthly_summaries(txn_lineitem(spark, d).txn)


def d2_category_breakdown(spark, d):
    L = txn_lineitem(spark, d)
    return D.category_breakdown(L.txn, L.as_of)


def d3_top_merchants(spark, d):
    L = txn_lineitem(spark, d)
    return D.top_merchants(L.txn, L.as_of)


def d14_dataset_profile(spark, d):
    return D.dataset_profile(txn_lineitem(spark, d).txn)


def d14_rows_per_category(spark, d):
    return D.rows_per_category(txn_lineitem(spark, d).txn)


def d17_dashboard_cards(spark, d):
    L = txn_lineitem(spark, d)
    return D.dashboard_cards(D.month_summary(L.txn, L.users, L.as_of), L.users)


def d18_category_share(spark, d):
    L = txn_lineitem(spark, d)
    return D.category_share(D.category_breakdown(L.txn, L.as_of))


def d19_daily_trend(spark, d):
    return D.daily_trend(txn_events(spark, d).txn)


def f1_list_page(spark, d):
    page = D.list_page(txn_events(spark, d).txn, skip=10, limit=20)
    return page.select(*[c for c in S.TRANSACTION_OUT_COLUMNS if c != "created_at"], "row_no")


def g2_distinct_values(spark, d):
    return D.distinct_values(txn_lineitem(spark, d).txn)


# ------------------------------------------------------------------ filters

def b1_filter_transactions(spark, d):
    t = B.filter_transactions(
        txn_events(spark, d).txn, category="Food", start_date=dt.date(2024, 1, 8), end_date=dt.date(2024, 1, 21)
    )
    return t.select("id", "user_id", "date", "amount", "category", "merchant")


def b2_by_month(spark, d):
    L = txn_lineitem(spark, d)
    return B.by_month(L.txn, L.as_of.year, L.as_of.month).select("user_id", "date", "amount", "category", "merchant")


def b3_current_or_latest_month(spark, d):
    L = txn_lineitem(spark, d)
    return B.current_or_latest_month(L.txn, L.as_of).select("user_id", "date", "amount", "category", "chosen_month")


def b4_recent_or_all(spark, d):
    L = txn_lineitem(spark, d)
    return B.recent_or_all(L.txn, L.as_of).select("user_id", "date", "amount", "category")


def b5_recent_windows(spark, d):
    L = txn_events(spark, d)
    return B.recent_windows(L.txn, L.as_of)


def b8_null_defaults(spark, d):
    return B.null_defaults(txn_events(spark, d).txn)


def c4_user_transactions(spark, d):
    L = txn_lineitem(spark, d)
    return B.user_transactions(L.users, L.txn).select("user_id", "date", "amount", "category", "monthly_income")


# ------------------------------------------------------------------ monthly

def _risk_frame(spark, d, keep_first=False):
    L = txn_lineitem(spark, d)
    return FE.risk_features(L.txn, L.users, keep_first_month=keep_first)


def d4_monthly_features(spark, d):
    m = FE.monthly_aggregates(txn_lineitem(spark, d).txn, with_ratios=False)
    return m.select(
        "user_id", "year_month", "total_spending", "transaction_count", "avg_transaction", "max_transaction",
        F.round("std_transaction", 4).alias("std_transaction"), "unique_categories", "unique_merchants",
    )


def d5_category_ratios(spark, d):
    return FE.category_ratios(txn_lineitem(spark, d).txn)


def d6_income_features(spark, d):
    L = txn_lineitem(spark, d)
    m = FE.income_features(FE.monthly_aggregates(L.txn, with_ratios=False), L.users)
    return m.select("user_id", "year_month", "total_spending", "monthly_income", "spending_to_income", "is_overspend")


def e1_e4_monthly_windows(spark, d):
    return _risk_frame(spark, d).select(
        "user_id", "year_month", "total_spending", "prev_month_spending", "spending_change", "rolling_3m_avg",
        F.round("rolling_3m_std", 4).alias("rolling_3m_std"),
    )


def e8_latest_month(spark, d):
    return FE.latest_row(_risk_frame(spark, d)).select("user_id", "year_month", "total_spending", "spending_to_income")


def h19_risk_bands(spark, d):
    """H19, H20, H27, H28 over a score derived from the latest month's
    spend / income (clipped at 1)."""
    latest = FE.latest_row(_risk_frame(spark, d)).select(
        "user_id", F.least(F.lit(1.0), F.col("spending_to_income")).alias("score")
    )
    return latest.select(
        "user_id",
        "score",
        H.risk_level("score").alias("risk_level"),
        H.gauge_band("score").alias("gauge_band"),
        H.score_band("score").alias("score_band"),
        H.level_text(H.risk_level("score")).alias("level_text"),
    )


# -------------------------------------------------------------------- daily

def d7_daily_totals(spark, d):
    return FE.daily_totals(txn_events(spark, d).txn).select("user_id", "ds", "y")


def d7_daily_totals_global(spark, d):
    return FE.daily_totals(txn_lineitem(spark, d).txn, per_user=False).select("ds", "y")


def e5_e6_daily_features(spark, d):
    f = FE.daily_features(FE.daily_totals(txn_events(spark, d).txn))
    cols = ["user_id", "ds", "y"]
    for k in S.FORECAST_WINDOWS:
        cols += [f"rolling_mean_{k}", F.round(f"rolling_std_{k}", 4).alias(f"rolling_std_{k}")]
    cols += [f"lag_{k}" for k in S.FORECAST_LAGS] + ["day_of_week", "day_of_month", "month"]
    return f.select(*cols)


def e10_chronological_split(spark, d):
    daily = FE.daily_totals(txn_events(spark, d).txn)
    return FE.chronological_split(daily, horizon=S.FORECAST_DEFAULT_DAYS).select("user_id", "ds", "is_train")


def i2_transaction_features(spark, d):
    from ..operators import models as M

    frame = B.null_defaults(txn_events(spark, d).txn)
    idx = M.fit_merchant_index(frame)
    f = M.apply_merchant_index(idx, FE.transaction_features(frame))
    return f.select(
        "id", "user_id", "day_of_week", "day_of_month", "month", "is_weekend", "is_month_start", "is_month_end",
        "quarter", "week_of_year", F.round("log_amount", 6).alias("log_amount"), "amount",
        F.col("merchant_encoded").cast("long").alias("merchant_encoded"),
    )


# ------------------------------------------------------------------ rollups

def d15_savings_position(spark, d):
    L = txn_events(spark, d)
    return FE.savings_position(L.txn, L.users, L.as_of)


def d15_savings_position_lineitem(spark, d):
    L = txn_lineitem(spark, d)
    return FE.savings_position(L.txn, L.users, L.as_of)


def d9_category_stats(spark, d):
    L = txn_lineitem(spark, d)
    return FE.category_stats(L.txn, L.users)


def d16_spending_velocity(spark, d):
    L = txn_events(spark, d)
    return FE.spending_velocity(L.txn, L.as_of)


def e7_three_month_rise(spark, d):
    return FE.three_month_rise(txn_lineitem(spark, d).txn)


def e9_category_trend(spark, d):
    return FE.category_trend(txn_lineitem(spark, d).txn)


def e12_group_stats_on_rows(spark, d):
    s = FE.group_stats_on_rows(txn_events(spark, d).txn)
    return s.select("id", "user_id", "category", "amount", "cat_mean", F.round("cat_std", 4).alias("cat_std"), "cat_count")


def e13_first_appearance(spark, d):
    f = FE.first_appearance(txn_events(spark, d).txn)
    return f.select(
        "user_id", "category", F.col("first_seen.date").alias("first_date"), F.col("first_seen.id").alias("first_id"),
        "appearance",
    )


# -------------------------------------------------------------------- rules

def j1_category_overspend(spark, d):
    L = txn_events(spark, d)
    return J.rule_category_overspend(L.txn, L.users, L.as_of).select(*RULE_OUT)


def j1_category_overspend_lineitem(spark, d):
    L = txn_lineitem(spark, d)
    return J.rule_category_overspend(L.txn, L.users, L.as_of).select(*RULE_OUT)


def j4_savings_rules(spark, d):
    L = txn_lineitem(spark, d)
    return J.rule_savings(FE.savings_position(L.txn, L.users, L.as_of)).select(*RULE_OUT)


def j5_anomaly(spark, d):
    return J.rule_anomaly(txn_events(spark, d).txn).select(*RULE_OUT)


def j6_rising_trend(spark, d):
    return J.rule_rising_trend(txn_lineitem(spark, d).txn).select(*RULE_OUT)


def j7_recommendations(spark, d):
    from . import jobs

    L = txn_events(spark, d)
    recs = jobs.recommendation_job(L.txn, L.users, L.as_of)
    return recs.select("user_id", "rec_index", "rule_id", "type", "priority", "confidence", "category", "amount")


def j8_recommendation_summary(spark, d):
    from . import jobs

    L = txn_events(spark, d)
    return J.recommendation_summary(jobs.recommendation_job(L.txn, L.users, L.as_of), L.users)


_SQL_CHECKED = [
    d1_month_summary, d1_monthly_summaries, d2_category_breakdown, d3_top_merchants, d14_dataset_profile,
    d14_rows_per_category, d17_dashboard_cards, d18_category_share, d19_daily_trend, f1_list_page,
    g2_distinct_values, b1_filter_transactions, b2_by_month, b3_current_or_latest_month, b4_recent_or_all,
    b5_recent_windows, b8_null_defaults, c4_user_transactions, d4_monthly_features, d5_category_ratios,
    d6_income_features, e1_e4_monthly_windows, e8_latest_month, h19_risk_bands, d7_daily_totals,
    d7_daily_totals_global, e5_e6_daily_features, e10_chronological_split, i2_transaction_features,
    d15_savings_position, d15_savings_position_lineitem, d9_category_stats, d16_spending_velocity,
    e7_three_month_rise, e9_category_trend, e12_group_stats_on_rows, e13_first_appearance,
    j1_category_overspend, j1_category_overspend_lineitem, j4_savings_rules, j5_anomaly, j6_rising_trend,
    j7_recommendations, j8_recommendation_summary,
]


def sql_checked_queries() -> dict[str, Query]:
    return {f.__name__: _q(f) for f in _SQL_CHECKED}


def all_queries() -> dict[str, Query]:
    out = sql_checked_queries()
    from .model_queries import model_queries  # imports this module's operators; a broken import fails here

    from .stored_queries import stored_queries

    out.update({k: _q(v) for k, v in {**model_queries(), **stored_queries()}.items()})
    return out


# ------------------------------------------------------------------ metrics

def _persistence_scored(spark, d):
    """The risk label against a persistence predictor taken from the data:
    last month's spend over 0.9 x income (prediction) and last month's
    spend / income (score)."""
    r = _risk_frame(spark, d)
    return r.select(
        F.col("is_overspend").alias("label"),
        (F.col("prev_month_spending") > F.col("monthly_income") * F.lit(S.OVERSPEND_INCOME_SHARE)).cast("int").alias(
            "prediction"
        ),
        (F.col("prev_month_spending") / F.col("monthly_income")).alias("score"),
    )


def d10_confusion_matrix(spark, d):
    from ..operators import metrics as M

    return M.confusion_matrix(_persistence_scored(spark, d))


def d10_per_class_metrics(spark, d):
    from ..operators import metrics as M

    return M.per_class_metrics(M.confusion_matrix(_persistence_scored(spark, d))).drop("tp")


def d10_classification_summary(spark, d):
    from ..operators import metrics as M

    return M.classification_summary(_persistence_scored(spark, d))


def d10_binary_summary(spark, d):
    from ..operators import metrics as M

    return M.binary_summary(_persistence_scored(spark, d))


def d11_auc_rank(spark, d):
    from ..operators import metrics as M

    return M.auc_rank(_persistence_scored(spark, d))


def d12_regression_metrics(spark, d):
    from ..operators import forecast as FC
    from ..operators import metrics as M

    m = M.regression_metrics(FC.naive_holdout(txn_events(spark, d).txn))
    return m.select(F.round("rmse", 6).alias("rmse"), F.round("mape", 6).alias("mape"), "n")


def d13_class_balance(spark, d):
    from ..operators import metrics as M

    return M.class_balance_frame(_persistence_scored(spark, d), "label")


def d13_balance_summary(spark, d):
    """Minority count and positive rate of the scored months."""
    from ..operators import metrics as M

    return M.class_balance_summary(_persistence_scored(spark, d), "label")


# ------------------------------------------------------------- explanations

def k1_explanation_figures(spark, d):
    """K1 dispatch + the figures of K2-K8, heuristic mode."""
    from . import jobs

    L = txn_events(spark, d)
    return jobs.explanation_figures_job(L.txn, L.users, L.as_of)


_SQL_CHECKED += [
    d10_confusion_matrix, d10_per_class_metrics, d10_classification_summary, d10_binary_summary, d11_auc_rank,
    d12_regression_metrics, d13_class_balance, d13_balance_summary, k1_explanation_figures,
]


# ------------------------------------------------------------ maintenance

def a2_validate_transactions(spark, d):
    from ..sources.adapters import LINEITEM_AS_OF, raw_upload_lineitem
    from ..sources.store import validate_transactions

    v = validate_transactions(raw_upload_lineitem(spark, d), LINEITEM_AS_OF)
    return v.select(
        "batch_id", F.col("user_id").try_cast("long").alias("user_id"), F.col("parsed_date").alias("date"),
        F.col("parsed_amount").alias("amount"), "category", "valid", F.array_join("errors", ",").alias("errors"),
    )


def a3_bulk_ingest(spark, d):
    from ..sources.adapters import LINEITEM_AS_OF, raw_upload_lineitem
    from ..sources.store import accept_batches

    accepted, _ = accept_batches(raw_upload_lineitem(spark, d), LINEITEM_AS_OF)
    return accepted.select("batch_id", "user_id", "date", "amount", "category", "merchant")


def a3_rejected_batches(spark, d):
    from ..sources.adapters import LINEITEM_AS_OF, raw_upload_lineitem
    from ..sources.store import accept_batches

    _, rejected = accept_batches(raw_upload_lineitem(spark, d), LINEITEM_AS_OF)
    return rejected.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("reason") == "invalid_row", 1)).alias("invalid_rows")
    )


def a7_purge_users(spark, d):
    """Users of the BUILDING segment close their accounts; their
    transactions go with them."""
    from ..sources.store import purge_users

    L = txn_lineitem(spark, d)
    removed = spark.read.parquet(f"{d.rstrip('/')}/customer.parquet").filter(
        F.col("c_mktsegment") == "BUILDING"
    ).select(F.col("c_custkey").alias("user_id"))
    _, txn = purge_users(L.users, L.txn, removed)
    return txn.select("user_id", "date", "amount", "category")


_SQL_CHECKED += [a2_validate_transactions, a3_bulk_ingest, a3_rejected_batches, a7_purge_users]


# ------------------------------------------------------------ more ops

def b9_fill_feature_nulls(spark, d):
    """The risk frame with NULL features set to 0 (a one-row month has
    no sample std; the first month has no change)."""
    L = txn_lineitem(spark, d)
    m = FE.monthly_windows(FE.income_features(FE.monthly_aggregates(L.txn, with_ratios=False), L.users))
    f = B.fill_feature_nulls(m, ["std_transaction", "spending_change", "prev_month_spending"])
    return f.select("user_id", "year_month", F.round("std_transaction", 4).alias("std_transaction"),
                    "spending_change", "prev_month_spending")


def c1_monthly_join_ratios(spark, d):
    """Monthly aggregates left-joined to the category ratios."""
    t = txn_lineitem(spark, d).txn
    j = FE.monthly_join_ratios(FE.monthly_aggregates(t, with_ratios=False), FE.category_ratios(t))
    return j.select("user_id", "year_month", "total_spending", "transaction_count", *S.RATIO_COLUMNS)


def f7_top_three_recs(spark, d):
    """the dashboard's first three recommendations per user."""
    from . import jobs

    L = txn_events(spark, d)
    recs = jobs.recommendation_job(L.txn, L.users, L.as_of)
    return recs.filter(F.col("rec_index") < 3).select("user_id", "rec_index", "rule_id", "priority", "category")


_SQL_CHECKED += [b9_fill_feature_nulls, c1_monthly_join_ratios, f7_top_three_recs]


# ----------------------------------------------------------------- messages

def j_messages(spark, d):
    """The recommendation messages of J1, J4a, J4b, J5, J6 as text."""
    from . import jobs

    L = txn_events(spark, d)
    return jobs.recommendation_job(L.txn, L.users, L.as_of).select("user_id", "rule_id", "pos", "message")


def j_messages_lineitem(spark, d):
    """H14/H15 over the lineitem adapter."""
    L = txn_lineitem(spark, d)
    r = FE.daily_rollup(L.txn)
    parts = [
        J.rule_category_overspend(r, L.users, L.as_of),
        J.rule_savings(FE.savings_position(r, L.users, L.as_of)),
        J.rule_rising_trend(r),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("user_id", "rule_id", "pos", "message")


_SQL_CHECKED += [j_messages, j_messages_lineitem]


def k_reasoning(spark, d):
    """K2-K8 reasoning texts (heuristic mode, reference dispatch)."""
    from . import jobs

    L = txn_events(spark, d)
    return jobs.explanation_job(L.txn, L.users, L.as_of).select("user_id", "rec_index", "kind", "reasoning")


_SQL_CHECKED += [k_reasoning]


def c7_rec_with_explanation(spark, d):
    """Recommendation n paired with explanation n (heuristic mode)."""
    from ..operators import explain as K
    from . import jobs

    L = txn_events(spark, d)
    recs = jobs.recommendation_job(L.txn, L.users, L.as_of)
    paired = K.pair_with_recommendations(recs, jobs.explanation_job(L.txn, L.users, L.as_of))
    return paired.select("user_id", "rec_index", "rule_id", "priority", "message", "kind", "reasoning")


_SQL_CHECKED += [c7_rec_with_explanation]


def a8_register_users(spark, d):
    """A8 + C6: every customer registers as a user next to the users already
    known from the events table; new ids continue after the largest one in
    customer-key order."""
    from ..sources.store import register_users

    existing = txn_events(spark, d).users
    batch = spark.read.parquet(f"{d.rstrip('/')}/customer.parquet").select(
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("full_name"),
        (F.lit(60000.0) + F.lit(3.0) * F.col("c_acctbal")).alias("monthly_income"),
        F.lit(None).cast("string").alias("currency"),
        F.col("c_custkey").alias("seq"),
    )
    users, _ = register_users(existing, batch)
    return users.select("user_id", "email", "full_name", "monthly_income", "currency")


_SQL_CHECKED += [a8_register_users]


def a6_replace_user_rows(spark, d):
    """Users who appear in the events table have their lineitem-derived
    rows replaced by their events rows (delete, then load)."""
    from ..sources.store import replace_user_rows

    old = txn_lineitem(spark, d).txn.drop("id")
    new = txn_events(spark, d).txn.drop("id")
    return replace_user_rows(old, new).select("user_id", "date", "amount", "category", "merchant")


_SQL_CHECKED += [a6_replace_user_rows]


def k_factors(spark, d):
    """K2-K8 contributing factors, one row per factor (heuristic mode)."""
    from . import jobs

    L = txn_events(spark, d)
    ex = jobs.explanation_job(L.txn, L.users, L.as_of)
    return ex.select("user_id", "rec_index", "kind", F.posexplode("contributing_factors").alias("pos", "factor"))


_SQL_CHECKED += [k_factors]


def k_impacts(spark, d):
    """K3/K4 feature-impact records, one row per impact (heuristic mode)."""
    from . import jobs

    L = txn_events(spark, d)
    ex = jobs.explanation_job(L.txn, L.users, L.as_of)
    e = ex.select("user_id", "rec_index", "kind", F.posexplode("feature_impacts").alias("pos", "imp"))
    return e.select("user_id", "rec_index", "kind", "pos", "imp.feature", "imp.importance", "imp.direction",
                    "imp.description")


_SQL_CHECKED += [k_impacts]
