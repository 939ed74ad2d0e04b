"""Edge frames and the reference's quirks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import D, txn_frame, users_frame
from ledgerspark.functions import scalars as H
from ledgerspark.operators import explain as K
from ledgerspark.operators import features as FE
from ledgerspark.operators import filters as B
from ledgerspark.operators import rules as J
from ledgerspark.operators import summary as SM


def test_month_summary_zero_row_and_days_with_spending(spark):
    t = txn_frame(spark, [(1, 1, "2025-06-01", 10.0, "Food"), (2, 1, "2025-06-01", 5.5, "Food"),
                          (3, 1, "2025-06-03", 4.5, "Rent")])
    u = users_frame(spark, [(1, 1000), (2, 500)])
    rows = {r.user_id: r for r in SM.month_summary(t, u, D("2025-06-30")).collect()}
    assert rows[1].total_spending == 20.0 and rows[1].transaction_count == 3
    assert rows[1].active_days == 2 and rows[1].daily_average == 10.0
    assert rows[2].total_spending == 0.0 and rows[2].transaction_count == 0 and rows[2].daily_average == 0.0
    assert rows[1].month == "2025-06"


def test_top_merchants_skip_null_and_empty_and_break_ties_by_name(spark):
    t = txn_frame(spark, [(1, 1, "2025-06-01", 10.0, "Food", "B"), (2, 1, "2025-06-02", 10.0, "Food", "A"),
                          (3, 1, "2025-06-02", 99.0, "Food", None), (4, 1, "2025-06-02", 99.0, "Food", "")])
    r = SM.top_merchants(t, D("2025-06-30")).orderBy("rank").collect()
    assert [(x.merchant, x.amount) for x in r] == [("A", 10.0), ("B", 10.0)]


def test_recent_window_is_strictly_after_as_of_minus_n(spark):
    # Q1: "now - 90 days" with a clock time after midnight excludes the date exactly 90 days back
    as_of = D("2025-06-30")
    t = txn_frame(spark, [(1, 1, as_of - dt.timedelta(days=90), 1.0, "Food"),
                          (2, 1, as_of - dt.timedelta(days=89), 2.0, "Food")])
    got = sorted(r.id for r in B.recent_or_all(t, as_of).collect())
    assert got == [2]
    # no recent rows at all -> all rows
    t2 = txn_frame(spark, [(1, 1, "2020-01-01", 1.0, "Food"), (2, 1, "2020-02-01", 2.0, "Food")])
    assert B.recent_or_all(t2, as_of).count() == 2


def test_velocity_windows_30_and_7(spark):
    as_of = D("2025-06-30")
    t = txn_frame(spark, [(1, 1, as_of - dt.timedelta(days=30), 100.0, "Food"),
                          (2, 1, as_of - dt.timedelta(days=7), 10.0, "Food"),
                          (3, 1, as_of - dt.timedelta(days=6), 50.0, "Food")])
    r = FE.spending_velocity(t, as_of).first()
    assert r.rows_30d == 2 and r.rows_7d == 1
    assert r.monthly_rate == 60.0 and r.weekly_rate == pytest.approx(215.0)
    assert r.accelerating  # 215 > 1.2 * 60


def test_lags_step_over_present_months_only(spark):
    # Q5: a missing month is not filled in
    t = txn_frame(spark, [(1, 1, "2025-01-05", 100.0, "Food"), (2, 1, "2025-03-05", 200.0, "Food"),
                          (3, 1, "2025-04-05", 300.0, "Food")])
    u = users_frame(spark, [(1, 1000)])
    r = FE.risk_features(t, u).orderBy("year_month").collect()
    assert [x.prev_month_spending for x in r] == [100.0, 200.0]
    assert r[0].spending_change == pytest.approx(1.0)
    assert r[0].rolling_3m_avg == pytest.approx(150.0)
    assert r[1].rolling_3m_avg == pytest.approx(200.0)


def test_single_row_rolling_std_is_zero(spark):
    t = txn_frame(spark, [(1, 1, "2025-01-05", 100.0, "Food")])
    u = users_frame(spark, [(1, 1000)])
    r = FE.risk_features(t, u, keep_first_month=True).first()
    assert r.rolling_3m_std == 0.0 and r.prev_month_spending is None


def test_ratio_columns_are_fixed_and_zero_filled(spark):
    t = txn_frame(spark, [(1, 1, "2025-01-05", 30.0, "Food"), (2, 1, "2025-01-06", 10.0, "Personal Care")])
    r = FE.category_ratios(t).first().asDict()
    assert r["ratio_food"] == 0.75 and r["ratio_personal_care"] == 0.25 and r["ratio_rent"] == 0.0
    assert len([k for k in r if k.startswith("ratio_")]) == 16


def test_overspend_label_is_strict(spark):
    t = txn_frame(spark, [(1, 1, "2025-01-05", 900.0, "Food"), (2, 2, "2025-01-05", 900.01, "Food")])
    u = users_frame(spark, [(1, 1000), (2, 1000)])
    m = FE.monthly_aggregates(t)
    got = {r.user_id: r.is_overspend for r in FE.income_features(m, u).collect()}
    assert got == {1: 0, 2: 1}


def _j1(spark, rows, income, as_of="2025-06-30"):
    t = txn_frame(spark, rows)
    u = users_frame(spark, [(1, income)])
    return J.rule_category_overspend(t, u, D(as_of)).orderBy("pos").collect()


def test_category_overspend_strict_and_priority(spark):
    # Food threshold .30: exactly at the threshold does not fire
    assert _j1(spark, [(1, 1, "2025-06-01", 300.0, "Food")], 1000) == []
    r = _j1(spark, [(1, 1, "2025-06-01", 400.0, "Food")], 1000)
    assert r[0].priority == "medium" and r[0].amount == pytest.approx(100.0)
    assert r[0].confidence == pytest.approx(0.8)
    r = _j1(spark, [(1, 1, "2025-06-01", 460.0, "Food")], 1000)
    assert r[0].priority == "high" and r[0].confidence == pytest.approx(0.86)
    # categories without a threshold never fire
    assert _j1(spark, [(1, 1, "2025-06-01", 999.0, "Rent")], 1000) == []


def test_category_overspend_falls_back_to_latest_month(spark):
    r = _j1(spark, [(1, 1, "2025-03-01", 400.0, "Food"), (2, 1, "2025-02-01", 900.0, "Shopping")], 1000)
    assert [x.category for x in r] == ["Food"]
    # the as_of month wins when it has rows
    r = _j1(spark, [(1, 1, "2025-06-01", 10.0, "Food"), (2, 1, "2025-05-01", 900.0, "Food")], 1000)
    assert r == []


def test_risk_ladder_is_ge_and_rule_is_gt(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.7,), (0.85,), (0.29,)], "p double")
    levels = {r.p: r.l for r in df.select("p", H.risk_level("p").alias("l")).collect()}
    assert levels == {0.3: "low", 0.5: "medium", 0.7: "high", 0.85: "critical", 0.29: "low"}
    risk = df.select(F.lit(1).cast("long").alias("user_id"), F.col("p").alias("overspend_probability"),
                     F.lit(0.0).alias("projected_spending"), F.lit(1000.0).alias("monthly_income"))
    got = {r.confidence: r.priority for r in J.rule_risk(risk).collect()}
    assert got == {0.5: "low", 0.7: "medium", 0.85: "high"}


def test_bands_and_labels(spark):
    df = spark.createDataFrame([(0.71,), (0.5,), (0.41,), (0.2,)], "p double")
    r = df.select(H.gauge_band("p").alias("g"), H.score_band("p").alias("s")).collect()
    assert [(x.g, x.s) for x in r] == [("#f43f5e", "rose"), ("#3b82f6", "amber"), ("#3b82f6", "amber"), ("#10b981", "emerald")]
    lv = spark.createDataFrame([("critical",), ("medium",), ("unknown",)], "l string")
    assert [x[0] for x in lv.select(H.level_text("l")).collect()] == ["Critical Risk", "Moderate Risk", "Low Risk"]


def _anoms(spark, amounts):
    rows = [(i, 1, dt.date(2025, 1, 1) + dt.timedelta(days=i), a, "Food") for i, a in enumerate(amounts)]
    return J.rule_anomaly(txn_frame(spark, rows)).collect()


def test_anomaly_group_bounds(spark):
    # with n rows the largest z is (n-1)/sqrt(n): 10 rows can never fire, 11 can
    assert _anoms(spark, [10.0] * 9 + [1000.0]) == []
    r = _anoms(spark, [10.0] * 10 + [1000.0])
    assert len(r) == 1 and r[0].amount == 1000.0
    # constant amounts: std == 0, nothing fires; fewer than 5 rows: nothing
    assert _anoms(spark, [10.0] * 30) == []
    assert _anoms(spark, [1.0, 1.0, 1.0, 100.0]) == []


def test_anomalies_first_five_in_appearance_order(spark):
    rows = []
    i = 0
    for cat in ["Rent", "Food"]:  # Rent appears first
        for k in range(60):
            rows.append((i, 1, dt.date(2025, 1, 1) + dt.timedelta(days=i), 10.0, cat))
            i += 1
        for k in range(3):
            rows.append((i, 1, dt.date(2025, 1, 1) + dt.timedelta(days=i), 500.0 + k, cat))
            i += 1
    r = sorted(J.rule_anomaly(txn_frame(spark, rows)).collect(), key=lambda x: x.pos)
    assert [x.category for x in r] == ["Rent"] * 3 + ["Food"] * 2
    assert [x.amount for x in r[3:]] == [500.0, 501.0]


def test_rising_trend_needs_strict_increase(spark):
    u = [(1, 1, "2025-01-05", 100.0, "Food"), (2, 1, "2025-02-05", 200.0, "Food"), (3, 1, "2025-03-05", 300.0, "Food")]
    r = J.rule_rising_trend(txn_frame(spark, u)).collect()
    assert len(r) == 1
    assert FE.three_month_rise(txn_frame(spark, u)).first().increase_pct == pytest.approx(200.0)
    eq = [(1, 1, "2025-01-05", 100.0, "Food"), (2, 1, "2025-02-05", 100.0, "Food"), (3, 1, "2025-03-05", 300.0, "Food")]
    assert J.rule_rising_trend(txn_frame(spark, eq)).collect() == []
    two = u[:2]
    assert J.rule_rising_trend(txn_frame(spark, two)).collect() == []


def test_savings_rules(spark):
    t = txn_frame(spark, [(1, 1, "2025-06-01", 500.0, "Food")])
    u = users_frame(spark, [(1, 1000)])
    sp = FE.savings_position(t, u, D("2025-06-30"))
    r = {x.rule_id: x for x in J.rule_savings(sp).collect()}
    assert r["J4a"].amount == 250.0 and r["J4b"].amount == 3000.0
    t2 = txn_frame(spark, [(1, 1, "2025-06-01", 850.0, "Food")])  # rate .15: only J4b
    r2 = [x.rule_id for x in J.rule_savings(FE.savings_position(t2, u, D("2025-06-30"))).collect()]
    assert r2 == ["J4b"]


def test_priority_sort_is_stable_in_rule_order(spark):
    t = txn_frame(spark, [(1, 1, "2025-06-01", 400.0, "Food"), (2, 1, "2025-06-02", 460.0, "Shopping"),
                          (3, 1, "2025-06-03", 10.0, "Rent")])
    u = users_frame(spark, [(1, 1000)])
    recs = J.recommendations(J.all_rules(t, u, D("2025-06-30"))).orderBy("rec_index").collect()
    pr = [r.priority for r in recs]
    assert pr == sorted(pr, key=lambda p: {"high": 0, "medium": 1, "low": 2}[p])
    assert recs[0].category == "Shopping"
    summ = J.recommendation_summary(J.recommendations(J.all_rules(t, u, D("2025-06-30"))), u).first()
    assert summ.n_high == 1 and "high-priority" in summ.summary


def test_summary_texts(spark):
    u = users_frame(spark, [(1, 1000)])
    empty = J.recommendations(J.all_rules(txn_frame(spark, [(1, 1, "2025-06-01", 999.0, "Rent")]), u,
                                          D("2025-06-30")))
    s = J.recommendation_summary(empty, u).first()
    assert s.n_recommendations == 0 and s.summary.startswith("Your finances look healthy")


def test_explanation_dispatch_reference_and_intent(spark):
    t = txn_frame(spark, [(1, 1, "2025-06-01", 400.0, "Food")] +
                  [(10 + i, 1, dt.date(2025, 3, 1) + dt.timedelta(days=i), 10.0, "Rent") for i in range(3)])
    u = users_frame(spark, [(1, 100000)])
    recs = J.recommendations(J.all_rules(t, u, D("2025-06-30")))
    ref = {r.rule_id: r.kind for r in K.explanation_figures(recs, t, u, D("2025-06-30")).collect()}
    assert ref.get("J4a") == "savings" and ref.get("J4b") == "default"
    ex = K.explain(K.explanation_figures(recs, t, u, D("2025-06-30"))).collect()
    assert all(r.reasoning for r in ex)
    assert all(len(r.contributing_factors) >= 2 for r in ex)


def test_js_round_and_share(spark):
    b = spark.createDataFrame([(1, "Food", 2.5), (1, "Rent", 7.49)], "user_id long, category string, total double")
    r = {x.category: x for x in SM.category_share(b).collect()}
    assert r["Food"].value == 3 and r["Rent"].value == 7
    assert r["Food"].share_pct == pytest.approx(30.0) and r["Rent"].rank == 1


def test_list_page_bounds_and_order(spark):
    t = txn_frame(spark, [(i, 1, "2025-06-01", 1.0, "Food") for i in range(5)])
    got = [r.id for r in SM.list_page(t, skip=1, limit=2, user_id=1).collect()]
    assert got == [3, 2]
    with pytest.raises(ValueError):
        SM.list_page(t, limit=501)
    per_user = [r.id for r in SM.list_page(t, skip=1, limit=2).orderBy("row_no").collect()]
    assert per_user == [3, 2]


def test_daily_features_lag_and_leak_free(spark):
    rows = [(i, 1, dt.date(2025, 1, 1) + dt.timedelta(days=i), float(i + 1), "Food") for i in range(10)]
    d = FE.daily_totals(txn_frame(spark, rows))
    f = FE.daily_features(d).orderBy("ds").collect()
    assert f[7].lag_7 == 1.0 and f[6].lag_7 is None
    assert f[2].rolling_mean_3 == pytest.approx(2.0)  # includes today (Q6)
    lf = FE.daily_features(d, leak_free=True).orderBy("ds").collect()
    assert lf[3].rolling_mean_3 == pytest.approx(2.0)  # ends yesterday


def test_chronological_split(spark):
    rows = [(i, 1, dt.date(2025, 1, 1) + dt.timedelta(days=i), 1.0, "Food") for i in range(50)]
    d = FE.chronological_split(FE.daily_totals(txn_frame(spark, rows)), horizon=30)
    assert d.filter("is_train").count() == 40  # max(50 - 30, int(0.8 * 50))


def test_weekday_and_iso_week(spark):
    df = spark.createDataFrame([(D("2024-01-06"),), (D("2024-12-30"),)], "d date")
    r = df.select(H.day_of_week("d").alias("w"), F.weekofyear("d").alias("k")).collect()
    assert (r[0].w, r[1].k) == (5, 1)


def test_null_defaults(spark):
    t = txn_frame(spark, [(1, 1, "2025-06-01", 1.0, "Food", None, None), (2, 1, "2025-06-01", 1.0, "Food", "", "x")])
    r = {x.id: x for x in B.null_defaults(t).collect()}
    assert r[1].merchant == "Unknown" and r[1].description == "" and r[2].merchant == "Unknown"


def test_scan_user_frame_empty_keeps_schema(spark):
    t = txn_frame(spark, [(1, 1, "2025-06-01", 1.0, "Food")])
    f = B.scan_user_frame(t, 2)
    assert f.count() == 0 and f.columns == ["user_id", "id", "date", "amount", "category", "merchant", "description"]


def test_rising_trend_steps_over_missing_month(spark):
    rows = [(1, 1, "2025-01-05", 100.0, "Food"), (2, 1, "2025-03-05", 200.0, "Food"), (3, 1, "2025-06-05", 300.0, "Food")]
    r = FE.three_month_rise(txn_frame(spark, rows)).first()
    assert r.rising and r.first_total == 100.0 and r.last_total == 300.0
    falling = [(1, 1, "2025-01-05", 300.0, "Food"), (2, 1, "2025-02-05", 200.0, "Food"), (3, 1, "2025-03-05", 100.0, "Food")]
    assert not FE.three_month_rise(txn_frame(spark, falling)).first().rising


def test_category_trend_needs_three_months(spark):
    rows = [(1, 1, "2025-01-05", 100.0, "Food"), (2, 1, "2025-02-05", 100.0, "Food"), (3, 1, "2025-03-05", 111.0, "Food"),
            (4, 1, "2025-01-05", 100.0, "Rent"), (5, 1, "2025-03-05", 500.0, "Rent")]
    got = {r.category: r.trend for r in FE.category_trend(txn_frame(spark, rows)).collect()}
    assert got == {"Food": "increasing", "Rent": "stable"}


def test_text_dispatch_equals_reference_mapping(spark, sf_small):
    # Q13: matching the message text gives the same kinds as the rule_id mapping
    from ledgerspark.plans import jobs
    from ledgerspark.sources.adapters import txn_events, txn_lineitem

    for adapter in (txn_lineitem, txn_events):
        L = adapter(spark, sf_small)
        recs = jobs.recommendation_job(L.txn, L.users, L.as_of)
        ref = K.explanation_figures(recs, L.txn, L.users, L.as_of, mode="reference").select("user_id", "rec_index", "kind")
        txt = K.explanation_figures(recs, L.txn, L.users, L.as_of, mode="text").select(
            "user_id", "rec_index", F.col("kind").alias("kind_text"))
        j = ref.join(txt, ["user_id", "rec_index"])
        assert j.count() == recs.count() > 0
        assert j.filter(F.col("kind") != F.col("kind_text")).count() == 0
