"""Explanations of recommendations (ops K1-K10, C7, F4, F5, H16, H22-H24, H26).

Dispatch is on ``rule_id`` (K1), not on message text. ``mode="reference"``
reproduces the mapping the reference's text matching actually yields
[Q13]: J1 and J5 get the category explanation, J2 and J6 the risk one, J3
the forecast one, J4a the category one when the user has Investments rows
and the savings one otherwise, J4b the default one. ``mode="intent"``
sends J5 to the anomaly text, J6 to the trend text and J4a to savings.

Everything the texts need is joined on ``user_id`` (and category) from
per-user aggregates; the per-recommendation work is one pass of column
expressions. ``explanation_figures`` is the flat, numeric form (checked
against SQL); ``explain`` adds reasoning, impacts and factors.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .. import texts as TX
from ..functions.scalars import contains_ci, feature_label, literal_map, plain_number, whole_number, whole_percent
from . import features as FE

IMPACT = "struct<feature:string,importance:double,direction:string,description:string>"


def _thresholds_map():
    return literal_map(S.CATEGORY_THRESHOLDS)


def describe_feature(name) -> F.Column:
    """K9: description of a risk feature, default text otherwise."""
    n = F.col(name) if isinstance(name, str) else name
    return F.coalesce(literal_map(S.FEATURE_DESCRIPTIONS)[n], F.concat(F.lit("Model feature: "), n))


def dispatch_by_text() -> F.Column:
    """K1 as the reference does it: the first matching case-insensitive
    substring of the message (H16) wins; a category with statistics for the
    user comes second (needs ``message``, ``category`` and ``has_stats``)."""
    msg = F.col("message")

    def has(*words):
        out = contains_ci(msg, words[0])
        for w in words[1:]:
            out = out | contains_ci(msg, w)
        return out

    return (
        F.when(has("overspend", "risk"), "risk")
        .when(F.col("category").isNotNull() & F.col("has_stats"), "category")
        .when(has("forecast"), "forecast")
        .when(has("invest", "saving"), "savings")
        .when(has("unusual", "anomal"), "anomaly")
        .when(has("trend", "increas"), "trend")
        .otherwise("default")
    )


def dispatch(mode: str = "reference") -> F.Column:
    """K1: explanation kind of a recommendation row. ``reference`` and
    ``intent`` dispatch on ``rule_id`` (+ ``has_investments``); ``text``
    matches the message like the reference (``dispatch_by_text``)."""
    r = F.col("rule_id")
    if mode == "text":
        return dispatch_by_text()
    if mode == "intent":
        return (
            F.when(r == "J1", "category")
            .when(r == "J2", "risk")
            .when(r == "J3", "forecast")
            .when(r == "J4a", "savings")
            .when(r == "J5", "anomaly")
            .when(r == "J6", "trend")
            .otherwise("default")
        )
    return (
        F.when(r.isin("J2", "J6"), "risk")
        .when(r.isin("J1", "J5"), "category")
        .when((r == "J4a") & F.col("has_investments"), "category")
        .when(r == "J3", "forecast")
        .when(r == "J4a", "savings")
        .otherwise("default")
    )


def explanation_figures(
    recs: DataFrame,
    txn: DataFrame,
    users: DataFrame,
    as_of: dt.date,
    risk: DataFrame | None = None,
    forecast: DataFrame | None = None,
    mode: str = "reference",
    rollup: DataFrame | None = None,
) -> DataFrame:
    """Per recommendation: kind and the figures its explanation states.
    Every figure derives from the daily rollup (pass the job's shared one)."""
    r = rollup if rollup is not None else FE.daily_rollup(txn)
    # a user's categories as one map (bounded: one entry a category), so that recommendations
    # meet them by user alone
    entry = F.struct("category", F.struct("pct_of_income", "monthly_avg", "trend"))
    stats = FE.category_stats(r, users).groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_stats"))
    sav = FE.savings_position(r, users, None).select(
        "user_id", F.col("savings").alias("savings_all"), F.col("savings_rate").alias("savings_rate_all"),
        F.col("monthly_avg").alias("monthly_avg_all"),
    )
    vel = FE.spending_velocity(r, as_of).select("user_id", "accelerating")
    rise = FE.three_month_rise(r).select("user_id", "first_total", "last_total", "increase_pct")
    j = (
        recs.join(users.select("user_id", "monthly_income"), "user_id")
        .join(stats, "user_id", "left")
        .withColumn("has_investments", F.coalesce(F.map_contains_key("_stats", F.lit("Investments")), F.lit(False)))
        .withColumn("_entry", F.col("_stats")[F.col("category")])
        .withColumns({"pct_of_income": F.col("_entry.pct_of_income"), "monthly_avg": F.col("_entry.monthly_avg"),
                      "trend": F.col("_entry.trend"), "has_stats": F.col("_entry").isNotNull()})
        .drop("_stats", "_entry")
        .join(sav, "user_id", "left")
        .join(vel, "user_id", "left")
        .join(rise, "user_id", "left")
    )
    if risk is not None:
        j = j.join(risk.select("user_id", "overspend_probability", "current_spending"), "user_id", "left")
    else:
        j = j.withColumns({"overspend_probability": F.lit(0.0), "current_spending": F.lit(0.0)})
    if forecast is not None:
        j = j.join(forecast.select("user_id", "total_predicted", "forecast_days", "model_used", "rmse"),
                   "user_id", "left")
    else:
        j = j.withColumns({
            "total_predicted": F.lit(0.0), "forecast_days": F.lit(S.FORECAST_DEFAULT_DAYS),
            "model_used": F.lit("unknown"), "rmse": F.lit(None).cast("double"),
        })
    j = j.withColumn("kind", dispatch(mode))
    thr = F.coalesce(_thresholds_map()[F.col("category")], F.lit(S.DEFAULT_CATEGORY_THRESHOLD))
    is_cat = F.col("kind") == "category"
    return j.select(
        "user_id",
        "rec_index",
        "rule_id",
        "category",
        "kind",
        "monthly_income",
        F.when(is_cat, F.coalesce("pct_of_income", F.lit(0.0))).alias("cat_share"),
        F.when(is_cat, thr).alias("cat_threshold"),
        F.when(is_cat, F.coalesce("monthly_avg", F.lit(0.0))).alias("cat_monthly_avg"),
        F.when(is_cat, F.coalesce("trend", F.lit("stable"))).alias("cat_trend"),
        F.when(
            is_cat,
            F.greatest(F.lit(0.0), F.coalesce("monthly_avg", F.lit(0.0)) - F.col("monthly_income") * thr),
        ).alias("cat_reduction"),
        F.when(F.col("kind") == "savings", F.col("savings_all")).alias("savings"),
        F.when(F.col("kind") == "savings", F.col("savings_rate_all")).alias("savings_rate"),
        F.when(F.col("kind") == "savings", F.col("monthly_avg_all")).alias("savings_monthly_avg"),
        F.when(F.col("kind") == "risk", F.coalesce("accelerating", F.lit(False))).alias("accelerating"),
        F.when(F.col("kind") == "risk", F.coalesce("overspend_probability", F.lit(0.0))).alias("risk_probability"),
        F.when(F.col("kind") == "risk", F.coalesce("current_spending", F.lit(0.0)) / F.col("monthly_income")).alias(
            "spend_share"
        ),
        F.when(F.col("kind") == "trend", F.col("increase_pct")).alias("trend_change_pct"),
        F.when(F.col("kind") == "trend", F.col("first_total")).alias("trend_first"),
        F.when(F.col("kind") == "trend", F.col("last_total")).alias("trend_last"),
        F.when(F.col("kind") == "forecast", F.col("total_predicted")).alias("forecast_total"),
        F.when(F.col("kind") == "forecast", F.col("forecast_days")).alias("forecast_days"),
        F.when(F.col("kind") == "forecast", F.col("model_used")).alias("forecast_model"),
        F.when(F.col("kind") == "forecast", F.col("rmse")).alias("forecast_rmse"),
    )


def _impact(feature, importance, direction, description):
    return F.struct(
        feature.cast("string").alias("feature"),
        importance.cast("double").alias("importance"),
        direction.cast("string").alias("direction"),
        description.cast("string").alias("description"),
    )


def risk_impacts(risk_importances: list | None, k: int = 5) -> F.Column:
    """F5 + K9 + H13: the first k risk-model importances as impact records
    (a literal array: the model has a fixed, small feature list)."""
    items = list(risk_importances or [])[:k]
    if not items:
        return F.array().cast(f"array<{IMPACT}>")
    return F.array(
        *[
            _impact(
                feature_label(F.lit(name)),
                F.lit(round(float(v), 4)),
                F.lit("positive" if v > 0 else "negative"),
                describe_feature(F.lit(name)),
            )
            for name, v in items
        ]
    )


def explain(figures: DataFrame, risk_importances: list | None = None) -> DataFrame:
    """K2-K8: reasoning text, feature impacts and contributing factors."""
    k = F.col("kind")
    cat = F.col("category")
    inc = F.col("monthly_income")
    no_text = F.array().cast("array<string>")
    no_impacts = F.array().cast(f"array<{IMPACT}>")

    # K2 risk
    risk_reason = F.format_string(
        TX.RISK_REASONING,
        whole_percent("risk_probability"),
        whole_number(F.col("spend_share") * inc),
        whole_number(inc),
        F.when(F.col("accelerating"), F.lit(TX.RISK_VELOCITY_CLAUSE)).otherwise(F.lit("")),
    )
    risk_factors = F.concat(
        F.when(F.col("accelerating"), F.array(F.lit(TX.RISK_VELOCITY_FACTOR))).otherwise(no_text),
        F.array(
            F.format_string(TX.RISK_SHARE_FACTOR, whole_percent("spend_share")),
            F.format_string(TX.RISK_MODEL_FACTOR, whole_percent("risk_probability")),
        ),
    )
    # K3 category
    increasing = F.col("cat_trend") == "increasing"
    cat_reason = F.format_string(
        TX.CATEGORY_REASONING,
        F.lower(cat),
        whole_percent("cat_share"),
        whole_percent("cat_threshold"),
        whole_number("cat_monthly_avg"),
        F.when(increasing, F.lit(TX.CATEGORY_TREND_CLAUSE)).otherwise(F.lit("")),
        whole_number("cat_reduction"),
    )
    cat_impacts = F.array(
        _impact(F.format_string(TX.CATEGORY_SHARE_FEATURE, cat), F.round("cat_share", 4), F.lit("positive"),
                F.format_string(TX.CATEGORY_SHARE_DESCRIPTION, F.lower(cat))),
        _impact(F.format_string(TX.CATEGORY_TREND_FEATURE, cat), F.when(increasing, F.lit(0.3)).otherwise(F.lit(0.1)),
                F.when(increasing, F.lit("positive")).otherwise(F.lit("negative")),
                F.format_string(TX.CATEGORY_TREND_DESCRIPTION, F.lower(cat), F.col("cat_trend"))),
    )
    cat_factors = F.array(
        F.format_string(TX.CATEGORY_SHARE_FACTOR, F.lower(cat), whole_percent("cat_share")),
        F.format_string(TX.CATEGORY_TREND_FACTOR,
                        F.when(increasing, F.lit("Increasing")).otherwise(F.lit("Stable"))),
        F.format_string(TX.CATEGORY_AVERAGE_FACTOR, whole_number("cat_monthly_avg")),
    )
    # K4 forecast
    fc_reason = F.format_string(
        TX.FORECAST_REASONING,
        F.col("forecast_model"),
        whole_number("forecast_total"),
        F.col("forecast_days"),
        F.when(F.col("forecast_total") > inc * F.lit(0.8), F.lit(TX.FORECAST_PRESSURE)).otherwise(
            F.lit(TX.FORECAST_MANAGEABLE)
        ),
    )
    fc_impacts = F.array(*[_impact(F.lit(f), F.lit(v), F.lit(d), F.lit(t)) for f, v, d, t in TX.FORECAST_IMPACTS])
    fc_factors = F.array(
        F.format_string(TX.FORECAST_MODEL_FACTOR, F.col("forecast_model")),
        F.format_string(TX.FORECAST_TOTAL_FACTOR, F.col("forecast_days"), whole_number("forecast_total")),
        F.format_string(TX.FORECAST_RMSE_FACTOR, F.coalesce(F.col("forecast_rmse").cast("string"), F.lit("N/A"))),
    )
    # K5 savings
    sav_reason = F.format_string(
        TX.SAVINGS_REASONING, whole_number("savings_monthly_avg"), whole_number("savings"), whole_percent("savings_rate")
    )
    sav_factors = F.array(
        F.format_string(TX.SAVINGS_RATE_FACTOR, whole_percent("savings_rate")),
        F.format_string(TX.SAVINGS_SURPLUS_FACTOR, whole_number("savings")),
        F.lit(TX.SAVINGS_FLOW_FACTOR),
    )
    # K6 anomaly
    an_reason = F.format_string(TX.ANOMALY_REASONING, F.coalesce(cat, F.lit("this")))
    an_factors = F.array(*[F.lit(t) for t in TX.ANOMALY_FACTORS])
    # K7 trend (empty when the user has fewer than three months)
    has_rise = F.col("trend_first").isNotNull()
    tr_reason = F.when(
        has_rise,
        F.format_string(TX.TREND_REASONING, plain_number("trend_change_pct"), whole_number("trend_first"),
                        whole_number("trend_last")),
    ).otherwise(F.lit(""))
    tr_factors = F.when(
        has_rise,
        F.array(
            F.format_string(TX.TREND_CHANGE_FACTOR, plain_number("trend_change_pct")),
            F.format_string(TX.TREND_FIRST_FACTOR, whole_number("trend_first")),
            F.format_string(TX.TREND_LAST_FACTOR, whole_number("trend_last")),
        ),
    ).otherwise(no_text)
    # K8 default
    default_reason = F.lit(TX.DEFAULT_REASONING)
    default_factors = F.array(*[F.lit(t) for t in TX.DEFAULT_FACTORS])

    reasoning = (
        F.when(k == "risk", risk_reason)
        .when(k == "category", cat_reason)
        .when(k == "forecast", fc_reason)
        .when(k == "savings", sav_reason)
        .when(k == "anomaly", an_reason)
        .when(k == "trend", tr_reason)
        .otherwise(default_reason)
    )
    impacts = (
        F.when(k == "risk", risk_impacts(risk_importances))
        .when(k == "category", cat_impacts)
        .when(k == "forecast", fc_impacts)
        .otherwise(no_impacts)
    )
    factors = (
        F.when(k == "risk", risk_factors)
        .when(k == "category", cat_factors)
        .when(k == "forecast", fc_factors)
        .when(k == "savings", sav_factors)
        .when(k == "anomaly", an_factors)
        .when(k == "trend", tr_factors)
        .otherwise(default_factors)
    )
    return figures.select(
        "user_id",
        "rec_index",
        "rule_id",
        "kind",
        reasoning.alias("reasoning"),
        impacts.alias("feature_impacts"),
        factors.alias("contributing_factors"),
    )


def pair_with_recommendations(recs: DataFrame, explanations: DataFrame) -> DataFrame:
    """Recommendation n with explanation n."""
    return recs.join(explanations.drop("rule_id"), ["user_id", "rec_index"], "left")


def numeric_metrics(metrics: dict) -> F.Column:
    """The numeric entries of the metrics document as a literal
    ``map<string,double>`` (a handful of model figures, not table data)."""
    num = [(k, float(v)) for k, v in (metrics or {}).items()
           if isinstance(v, (int, float)) and not isinstance(v, bool)]
    if not num:
        return F.create_map().cast("map<string,double>")
    return literal_map(num)


def importance_map(pairs: list | None) -> F.Column:
    """F4 as a literal ``map<string,double>`` (at most 20 entries)."""
    if not pairs:
        return F.create_map().cast("map<string,double>")
    return literal_map([(k, float(v)) for k, v in pairs])


def explain_report(explanations: DataFrame, metrics: dict | None = None,
                   global_importances: list | None = None) -> DataFrame:
    """Per user, the explanations list plus the numeric model metrics
    and the global top-20 importances (both global, attached as literals)."""
    per_user = explanations.groupBy("user_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rec_index", "reasoning", "feature_impacts", "contributing_factors"))
        ).alias("explanations")
    )
    return per_user.select(
        "user_id",
        "explanations",
        numeric_metrics(metrics).alias("model_metrics"),
        importance_map(global_importances).alias("feature_importance_global"),
    )
