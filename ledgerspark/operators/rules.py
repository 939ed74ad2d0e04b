"""Recommendation rules (ops J1-J8, C3, G1, F2, F3, E11, D20, I18).

Each rule is a DataFrame with the same columns, one row per
recommendation: ``user_id, rule_no, pos, rule_id, type, priority,
confidence, category, amount, message`` plus the rule's own figures.
``amount`` is left unrounded (the 2-dp rounding belongs to presentation,
``present``); all six are unioned (G1) and ranked per user (F2, E11).

Rules read two cached parents in a full job (monthly totals and category
stats); as standalone queries each is one aggregate over the fact table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from .. import texts as TX
from ..functions.scalars import month_start, plain_number, priority_rank, whole_number, whole_percent
from .features import as_rollup, group_stats_on_rows, savings_position, three_month_rise

RULE_COLUMNS = [
    "user_id",
    "rule_no",
    "pos",
    "rule_id",
    "type",
    "priority",
    "confidence",
    "category",
    "amount",
    "message",
]


def _rule(df: DataFrame, rule_no: int, rule_id: str, pos, typ, priority, confidence, category, amount, message):
    return df.select(
        F.col("user_id"),
        F.lit(rule_no).alias("rule_no"),
        pos.cast("int").alias("pos"),
        F.lit(rule_id).alias("rule_id"),
        typ.alias("type"),
        priority.alias("priority"),
        confidence.cast("double").alias("confidence"),
        category.cast("string").alias("category"),
        amount.cast("double").alias("amount"),
        message.alias("message"),
    )


def thresholds_frame(spark: SparkSession) -> DataFrame:
    """The 8 category thresholds with their rule order (a literal table,
    8 rows: a proven size bound, safe to broadcast)."""
    rows = [(c, float(t), i) for i, (c, t) in enumerate(S.CATEGORY_THRESHOLDS)]
    return spark.createDataFrame(rows, "category string, threshold double, pos int")


def chosen_month_spend(txn: DataFrame, as_of: dt.date) -> DataFrame:
    """B3 on the aggregate: per user and category, spend of ``as_of``'s month,
    or of the user's latest month with data when that month is empty. The
    choice is a window over the (user, month, category) aggregate, which is
    bounded per user by months x 16 rows, so the fact table is read once."""
    ym = month_start("date")
    per = as_rollup(txn).groupBy("user_id", ym.alias("year_month"), "category").agg(
        F.sum("cents").alias("cents")
    )
    as_of_ym = F.trunc(F.lit(as_of), "MM")
    w = Window.partitionBy("user_id")
    chosen = F.coalesce(
        F.max(F.when(F.col("year_month") == as_of_ym, F.col("year_month"))).over(w),
        F.max("year_month").over(w),
    )
    return per.withColumn("chosen_month", chosen).filter(F.col("year_month") == F.col("chosen_month"))


def rule_category_overspend(txn: DataFrame, users: DataFrame, as_of: dt.date) -> DataFrame:
    """Category spend of the chosen month over income above the
    category's threshold (strict ``>``)."""
    spark = txn.sparkSession
    spend = chosen_month_spend(txn, as_of)
    j = spend.join(F.broadcast(thresholds_frame(spark)), "category").join(
        users.select("user_id", "monthly_income"), "user_id"
    )
    spent = F.col("cents") / F.lit(100.0)
    pct = spent / F.col("monthly_income")
    thr = F.col("threshold")
    j = j.withColumns({"spent": spent, "pct": pct}).filter(F.col("pct") > thr)
    excess = F.col("spent") - F.col("monthly_income") * thr
    msg = F.format_string(
        TX.CATEGORY_OVERSPEND,
        F.lower("category"),
        whole_number(excess),
        whole_percent("pct"),
        whole_percent(thr),
    )
    return _rule(
        j,
        1,
        "J1",
        F.col("pos"),
        F.lit("warning"),
        F.when(F.col("pct") > thr * F.lit(1.5), F.lit("high")).otherwise(F.lit("medium")),
        F.least(F.lit(0.95), F.lit(0.7) + (F.col("pct") - thr)),
        F.col("category"),
        excess,
        msg,
    )


def rule_risk(risk: DataFrame) -> DataFrame:
    """Probability > .7 / > .5 / > .3 (strict, unlike the H19 ladder).
    ``risk``: user_id, overspend_probability, projected_spending, monthly_income."""
    p = F.col("overspend_probability")
    r = risk.filter(p > 0.3)
    msg = (
        F.when(
            p > 0.7,
            F.format_string(
                TX.RISK_HIGH,
                whole_percent(p),
                whole_number(F.coalesce("projected_spending", F.lit(0.0))),
                whole_number("monthly_income"),
            ),
        )
        .when(
            p > 0.5,
            F.format_string(
                TX.RISK_MEDIUM,
                whole_percent(p),
            ),
        )
        .otherwise(
            F.format_string(
                TX.RISK_LOW,
                whole_percent(p),
            )
        )
    )
    return _rule(
        r,
        2,
        "J2",
        F.lit(0),
        F.when(p > 0.7, F.lit("alert")).when(p > 0.5, F.lit("warning")).otherwise(F.lit("suggestion")),
        F.when(p > 0.7, F.lit("high")).when(p > 0.5, F.lit("medium")).otherwise(F.lit("low")),
        p,
        F.lit(None),
        F.lit(None),
        msg,
    )


def rule_forecast(forecast: DataFrame) -> DataFrame:
    """30-day equivalent of the forecast total over 0.95 / 0.8 x income.
    ``forecast``: user_id, total_predicted, forecast_days, monthly_income."""
    proj = (F.col("total_predicted") / F.greatest(F.col("forecast_days"), F.lit(1))) * 30
    f = forecast.withColumn("monthly_projected", proj)
    hi = F.col("monthly_projected") > F.col("monthly_income") * F.lit(0.95)
    mid = F.col("monthly_projected") > F.col("monthly_income") * F.lit(0.8)
    f = f.filter(hi | mid)
    msg = F.when(
        hi,
        F.format_string(
            TX.FORECAST_HIGH,
            whole_number("total_predicted"),
            F.col("forecast_days"),
        ),
    ).otherwise(
        F.format_string(
            TX.FORECAST_MEDIUM,
            whole_number("total_predicted"),
            F.col("forecast_days"),
            whole_percent(F.col("monthly_projected") / F.col("monthly_income")),
        )
    )
    return _rule(
        f,
        3,
        "J3",
        F.lit(0),
        F.when(hi, F.lit("alert")).otherwise(F.lit("warning")),
        F.when(hi, F.lit("high")).otherwise(F.lit("medium")),
        F.when(hi, F.lit(0.85)).otherwise(F.lit(0.75)),
        F.lit(None),
        F.when(hi, F.col("monthly_projected") - F.col("monthly_income")),
        msg,
    )


def rule_savings(savings: DataFrame) -> DataFrame:
    """J4a (invest half of the savings when the rate > 0.20) and J4b
    (emergency fund of 3 x income when savings > 0 and rate > 0.1)."""
    rate = F.col("savings_rate")
    invest = savings.filter(rate > S.SAVINGS_INVEST_THRESHOLD)
    investable = F.col("savings") * F.lit(0.5)
    j4a = _rule(
        invest,
        4,
        "J4a",
        F.lit(0),
        F.lit("suggestion"),
        F.lit("low"),
        F.lit(0.8),
        F.lit("Investments"),
        investable,
        F.format_string(
            TX.INVEST,
            whole_number(investable),
            whole_percent(rate),
            whole_number("savings"),
        ),
    )
    fund = savings.filter((F.col("savings") > 0) & (rate > 0.1))
    amount = F.col("monthly_income") * F.lit(float(S.MIN_EMERGENCY_FUND_MONTHS))
    j4b = _rule(
        fund,
        4,
        "J4b",
        F.lit(1),
        F.lit("suggestion"),
        F.lit("low"),
        F.lit(0.7),
        F.lit(None),
        amount,
        F.format_string(
            TX.EMERGENCY_FUND,
            whole_number(amount),
            F.lit(S.MIN_EMERGENCY_FUND_MONTHS),
        ),
    )
    return j4a.unionByName(j4b)


def anomalies(txn: DataFrame) -> DataFrame:
    """J5 rows: categories with >= 5 rows and a non-zero sample std, rows
    above mean + 3 x std (the row itself included in the statistics)."""
    s = group_stats_on_rows(txn, with_first=True)
    hits = s.filter(
        (F.col("cat_count") >= 5)
        & (F.col("cat_std") != 0)
        & (F.col("amount") > F.col("cat_mean") + F.lit(3.0) * F.col("cat_std"))
    )
    return hits.select("user_id", "id", "date", "category", "amount", "cat_mean", "cat_std", "cat_count", "first_seen")


def rule_anomaly(txn: DataFrame, limit: int = S.MAX_ANOMALIES) -> DataFrame:
    """J5 + F3: the first ``limit`` anomalies per user in category-appearance
    order (that of the category's first row, E13), then row order (not the largest
    ones)."""
    hits = anomalies(txn)
    w = Window.partitionBy("user_id").orderBy("first_seen", "date", "id")
    top = hits.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)
    top = top.withColumn("pos", F.col("pos") - 1)
    msg = F.format_string(
        TX.ANOMALY,
        F.lower("category"),
        whole_number("amount"),
        F.date_format("date", "yyyy-MM-dd"),
        whole_number("cat_mean"),
    )
    return _rule(
        top, 5, "J5", F.col("pos"), F.lit("alert"), F.lit("medium"), F.lit(0.85),
        F.col("category"), F.col("amount"), msg,
    )


def rule_rising_trend(txn: DataFrame) -> DataFrame:
    """The last three present months strictly increasing."""
    r = three_month_rise(txn).filter("rising")
    msg = F.format_string(
        TX.RISING_TREND,
        plain_number("increase_pct"),
    )
    return _rule(
        r, 6, "J6", F.lit(0), F.lit("warning"), F.lit("medium"), F.lit(0.75),
        F.lit(None), F.lit(None), msg,
    )


def heuristic_inputs(users: DataFrame, forecast_days: int = S.FORECAST_DEFAULT_DAYS):
    """Model outputs when no model is available: risk 0 / ``unknown``,
    forecast 0 over 30 days. The rules still run."""
    risk = users.select(
        "user_id",
        F.lit(0.0).alias("overspend_probability"),
        F.lit("unknown").alias("risk_level"),
        F.lit(0.0).alias("current_spending"),
        F.lit(0.0).alias("projected_spending"),
        "monthly_income",
    )
    forecast = users.select(
        "user_id",
        F.lit(0.0).alias("total_predicted"),
        F.lit(forecast_days).alias("forecast_days"),
        "monthly_income",
    )
    return risk, forecast


def all_rules(
    txn: DataFrame,
    users: DataFrame,
    as_of: dt.date,
    risk: DataFrame | None = None,
    forecast: DataFrame | None = None,
    rollup: DataFrame | None = None,
) -> DataFrame:
    """G1: the six rules in fixed order.

    ``rollup`` is the shared daily rollup (``features.daily_rollup``); a job
    passes one materialized rollup to every rule so the fact table is read
    once for J1, J4 and J6 (J5 needs the raw rows)."""
    if risk is None or forecast is None:
        h_risk, h_fc = heuristic_inputs(users)
        risk = risk if risk is not None else h_risk
        forecast = forecast if forecast is not None else h_fc
    r = rollup if rollup is not None else txn
    parts = [
        rule_category_overspend(r, users, as_of),
        rule_risk(risk),
        rule_forecast(forecast),
        rule_savings(savings_position(r, users, as_of)),
        rule_anomaly(txn),
        rule_rising_trend(r),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recommendations(rules: DataFrame) -> DataFrame:
    """J7 (F2 + E11): per user, high, medium, low, others last; stable in
    rule order and order inside the rule; ``rec_index`` from 0. At most
    8 + 1 + 1 + 2 + 5 + 1 rows per user, so the window is small."""
    w = Window.partitionBy("user_id").orderBy(
        priority_rank("priority"), F.col("rule_no"), F.col("rule_id"), F.col("pos")
    )
    return rules.withColumn("rec_index", F.row_number().over(w) - 1)


def recommendation_summary(recs: DataFrame, users: DataFrame) -> DataFrame:
    """J8 + D20: total and high-priority counts and the summary text; users
    without recommendations get the healthy text."""
    counts = recs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_recommendations"),
        F.count(F.when(F.col("priority") == "high", 1)).alias("n_high"),
    )
    j = users.select("user_id").join(counts, "user_id", "left").na.fill(0, ["n_recommendations", "n_high"])
    n, h = F.col("n_recommendations"), F.col("n_high")
    text = (
        F.when(n == 0, F.lit(TX.SUMMARY_HEALTHY))
        .when(h >= 3, F.format_string(TX.SUMMARY_CRITICAL, h))
        .when(h >= 1, F.format_string(TX.SUMMARY_REVIEW, n, h))
        .otherwise(F.format_string(TX.SUMMARY_SUGGESTIONS, n))
    )
    return j.select("user_id", "n_recommendations", "n_high", text.alias("summary"))


def present(recs: DataFrame, users: DataFrame | None = None, generated_at: dt.datetime | None = None) -> DataFrame:
    """J7 record per user: recommendations (sorted, amounts at 2 dp), ``generated_at`` (ISO text;
    the time of the job if not given) and the summary (J8). With ``users``, those
    without a recommendation have a record, too."""
    item = F.struct(
        F.col("rec_index"),
        F.col("type"),
        F.col("priority"),
        F.col("message"),
        F.col("confidence"),
        F.col("category"),
        F.round("amount", 2).alias("amount"),
    )
    lists = recs.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("recommendations"))
    users = users if users is not None else recs.select("user_id").distinct()
    at = F.lit(generated_at.isoformat()) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    empty = F.array().cast(lists.schema["recommendations"].dataType)
    return recommendation_summary(recs, users).join(lists, "user_id", "left").select(
        "user_id", F.coalesce("recommendations", empty).alias("recommendations"), at.alias("generated_at"), "summary"
    )
