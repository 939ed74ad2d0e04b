"""Model invariants and exact metric values on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import D, txn_frame, users_frame
from ledgerspark.operators import forecast as FC
from ledgerspark.operators import metrics as M
from ledgerspark.operators import models as MD
from ledgerspark.plans import jobs
from ledgerspark.sources.adapters import txn_events, txn_lineitem


def test_auc_rank_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    assert M.auc_rank(df).first().auc == pytest.approx(0.75)
    ties = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.1), (1, 0.9)], "label int, score double")
    # pairs: (0.9>0.5, 0.9>0.1, 0.5=0.5 -> .5, 0.5>0.1) = 3.5 / 4
    assert M.auc_rank(ties).first().auc == pytest.approx(0.875)
    one = spark.createDataFrame([(1, 0.5), (1, 0.6)], "label int, score double")
    assert M.auc_rank(one).first().auc == 0.5


def test_auc_rank_matches_evaluator_on_many_scores(spark):
    df = spark.range(0, 2000).select(
        (F.col("id") % 3 == 0).cast("int").alias("label"),
        (F.sin(F.col("id")) + F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.0)).alias("score"),
    )
    got = M.auc_rank(df).first().auc
    ev = M.binary_metrics(df.withColumn("prediction", (F.col("score") > 0.5).cast("int")))["auc"]
    assert got == pytest.approx(ev, abs=1e-4)


def test_count_before_is_a_running_count(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("s"), F.lit(2).alias("cnt"))
    rows = M.count_before(df, "s", "cnt", parts=7).collect()
    assert all(r.before == 2 * r.s for r in rows)
    words = spark.createDataFrame([(w, 1) for w in ["pear", "apple", "fig", "kiwi", "apple2"]], "s string, cnt int")
    got = {r.s: r.before for r in M.count_before(words, "s", "cnt", parts=3).collect()}
    assert got == {"apple": 0, "apple2": 1, "fig": 2, "kiwi": 3, "pear": 4}


def test_classification_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 2)], "label int, prediction int")
    m = M.classification_metrics(df)
    assert m["accuracy"] == pytest.approx(0.8)
    # per class f1: 0: p=1,r=.5 -> .6667; 1: p=2/3,r=1 -> .8; 2: 1
    assert m["f1_macro"] == pytest.approx(round((2 / 3 + 0.8 + 1) / 3, 4))


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "y double, prediction double")
    r = M.regression_metrics(df).first()
    assert r.rmse == pytest.approx((0.5) ** 0.5) and r.mape == pytest.approx(50.0)


def test_evaluation_plan():
    assert MD.evaluation_plan(12, 1, 1) == ("constant", 0)
    assert MD.evaluation_plan(12, 4, 2) == ("kfold", 4)
    assert MD.evaluation_plan(12, 3, 2) == ("split", 0)
    assert MD.evaluation_plan(5, 1, 2) == ("split", 0)
    assert MD.evaluation_plan(3, 1, 2) == ("none", 0)


def test_constant_risk_model_when_one_class(spark):
    # every month overspends: one class -> constant model, fixed metrics
    rows = [(i, 1, dt.date(2025, 1 + i, 1), 5000.0, "Food") for i in range(6)]
    t = txn_frame(spark, rows)
    u = users_frame(spark, [(1, 1000)])
    rm = MD.fit_risk_model(t, u, max_iter=3)
    assert rm.pipeline is None and rm.constant_class == 1
    assert rm.metrics["risk_auc_roc"] == 0.5 and rm.metrics["risk_accuracy"] == 1.0
    assert rm.metrics["overspend_rate"] == 1.0
    s = MD.risk_score(rm, t, u).first()
    assert s.overspend_probability == 1.0 and s.risk_level == "critical"
    assert s.projected_spending == 2 * s.current_spending and s.days_remaining == 30


def test_merchant_index_unseen_and_unknown(spark):
    train = txn_frame(spark, [(1, 1, "2025-01-01", 1.0, "Food", "b"), (2, 1, "2025-01-01", 1.0, "Food", "a")])
    idx = MD.fit_merchant_index(train)
    assert list(idx.labels) == ["a", "b"]
    new = txn_frame(spark, [(3, 1, "2025-01-01", 1.0, "Food", "zz"), (4, 1, "2025-01-01", 1.0, "Food", None)])
    got = sorted(r.merchant_encoded for r in MD.apply_merchant_index(idx, new).collect())
    assert got == [2.0, 2.0]  # Unknown appended last
    seen = {r.merchant: r.merchant_encoded for r in MD.apply_merchant_index(idx, train).collect()}
    assert seen == {"a": 0.0, "b": 1.0}
    train2 = txn_frame(spark, [(1, 1, "2025-01-01", 1.0, "Food", None), (2, 1, "2025-01-01", 1.0, "Food", "a")])
    idx2 = MD.fit_merchant_index(train2)
    assert list(idx2.labels) == ["Unknown", "a"]
    got2 = sorted(r.merchant_encoded for r in MD.apply_merchant_index(idx2, new).collect())
    assert got2 == [0.0, 0.0]  # unseen -> the trained Unknown id


def test_category_model_and_predictions(spark, sf_small):
    t = txn_events(spark, sf_small).txn
    cm = MD.fit_category_model(t, num_trees=3, max_depth=3, folds=2)
    assert 0.0 <= cm.metrics["classifier_accuracy"] <= 1.0
    p = MD.predict_category(cm, t)
    assert p.count() == t.count()
    assert p.filter((F.col("confidence") < 0) | (F.col("confidence") > 1)).count() == 0
    last = MD.last_ten_predictions(p)
    assert last.groupBy("user_id").count().filter("count > 10").count() == 0
    assert sorted(r.transaction_id for r in last.filter(F.col("user_id") == last.first().user_id).collect())[0] == 1


def test_risk_model_scores_every_user(spark, sf_small):
    L = txn_lineitem(spark, sf_small)
    rm = MD.fit_risk_model(L.txn, L.users, max_iter=3)
    s = MD.risk_score(rm, L.txn, L.users)
    assert s.count() == L.users.count()
    assert s.filter((F.col("overspend_probability") < 0) | (F.col("overspend_probability") > 1)).count() == 0
    levels = {r.risk_level for r in s.select("risk_level").distinct().collect()}
    assert levels <= {"low", "medium", "high", "critical"}
    assert len(rm.importances) == len(rm.features)


def test_ridge_forecast_points_and_insufficient_data(spark, sf_small):
    L = txn_lineitem(spark, sf_small)
    fm = FC.fit_ridge(L.txn)
    assert fm.metrics["forecast_rmse"] >= 0
    pts = FC.forecast_points(fm, L.txn, L.users, days=14)
    per = pts.groupBy("user_id").count()
    assert per.filter("count != 14").count() == 0
    assert pts.filter((F.col("predicted_amount") < 0) | (F.col("lower_bound") > F.col("upper_bound"))).count() == 0
    summ = FC.forecast_summary(pts, fm, 14)
    insufficient = summ.filter(F.col("model_used") == "Insufficient Data")
    assert insufficient.filter(F.col("total_predicted") != 0).count() == 0
    with pytest.raises(ValueError):
        FC.forecast_points(fm, L.txn, L.users, days=5)


def test_ridge_penalty_matches_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    n = 200
    X = rng.normal(size=(n, 3))
    y = X @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(X, y)],
                               "a double, b double, c double, y double")
    alpha = 50.0
    model = FC._ridge(["a", "b", "c"], FC._ridge_reg(df, alpha)).fit(df)
    coef = np.array(model.stages[-1].coefficients)
    Xc, yc = X - X.mean(0), y - y.mean()
    exact = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    assert np.allclose(coef, exact, atol=1e-6)


def test_seasonal_forecast(spark, sf_small):
    fm = FC.fit_seasonal(txn_lineitem(spark, sf_small).txn)
    pts = FC.seasonal_points(fm, days=30).collect()
    assert len(pts) == 30 and all(p.lower_bound <= p.predicted_amount <= p.upper_bound for p in pts)
    assert pts[0].date == fm.extra["d1"] + dt.timedelta(days=1)


def test_train_all_and_reports(spark, sf_small):
    L = txn_events(spark, sf_small)
    m = jobs.train_all(L.txn, L.users, num_trees=3, risk_iters=3, folds=2)
    view = jobs.model_metrics_view(spark, m.metrics).first()
    assert 0 <= view.classifier_accuracy <= 1
    rep = jobs.prediction_report(L.txn, L.users, m, days=14)
    r = rep.first()
    assert r.risk.risk_level in {"low", "medium", "high", "critical"}
    assert len(r.forecast.forecast) == 14
    ex = jobs.explain_report(L.txn, L.users, L.as_of, m)
    e = ex.first()
    assert all(x.reasoning for x in e.explanations)
    assert len(e.feature_importance_global) <= 20
    assert "classifier_accuracy" in e.model_metrics


def test_forecast_needs_eight_dates(spark):
    # lag 7 plus one row needs 8 dates
    rows = [(i, 1, dt.date(2025, 1, 1) + dt.timedelta(days=i), 10.0 + i, "Food") for i in range(7)]
    rows += [(100 + i, 2, dt.date(2025, 1, 1) + dt.timedelta(days=i), 10.0 + i, "Food") for i in range(8)]
    rows += [(200 + i, 3, dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0 + (i % 7), "Food") for i in range(120)]
    t = txn_frame(spark, rows)
    u = users_frame(spark, [(1, 1000), (2, 1000), (3, 1000)])
    fm = FC.fit_ridge(t)
    s = {r.user_id: r for r in FC.forecast_summary(FC.forecast_points(fm, t, u, 14), fm, 14).collect()}
    assert s[1].model_used == "Insufficient Data" and s[1].total_predicted == 0.0
    assert s[2].model_used == "regression_fallback"
    pts = FC.forecast_points(fm, t, u, 14).filter("user_id = 1").orderBy("date").collect()
    assert pts[0].date == dt.date(2025, 1, 8)  # horizon starts after the last transaction date


def test_risk_score_zeros_for_one_month_user(spark):
    rows = [(i, 1, dt.date(2025, 1 + (i % 6), 1 + i // 6), 300.0 + 500 * (i % 2), "Food") for i in range(24)]
    rows += [(100, 2, dt.date(2025, 3, 1), 50.0, "Food")]
    t = txn_frame(spark, rows)
    u = users_frame(spark, [(1, 1000), (2, 1000)])
    rm = MD.fit_risk_model(t, u, max_iter=3)
    s = {r.user_id: r for r in MD.risk_score(rm, t, u).collect()}
    assert s[2].overspend_probability == 0.0 and s[2].risk_level == "low" and s[2].current_spending == 0.0


def test_batch_job_writes_every_output(spark, sf_small, tmp_path):
    from ledgerspark.plans import run as R
    from ledgerspark.sources.adapters import txn_events

    out = str(tmp_path / "out")
    metrics = R.run(spark, txn_events(spark, sf_small), out, num_trees=2, risk_iters=2, folds=2, forecast_days=10)
    assert "classifier_accuracy" in metrics
    for name in ["predictions", "recommendations", "explanations", "month_summary", "monthly_summaries"]:
        assert spark.read.parquet(f"{out}/{name}").count() > 0
    assert spark.read.json(f"{out}/metrics").count() == 1


def test_seasonal_forecast_in_reports(spark, sf_small):
    L = txn_lineitem(spark, sf_small)
    m = jobs.Models(forecast=FC.fit_forecaster(L.txn, model="seasonal"))
    risk, fc, pts = jobs.model_outputs(L.txn, L.users, m, 14)
    per_user = pts.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("predicted_amount").alias("t"))
    assert per_user.filter("n != 14").count() == 0
    # every user's series gets its own fit, starting after the user's own last day
    last = L.txn.groupBy("user_id").agg(F.max("date").alias("last"))
    first = pts.groupBy("user_id").agg(F.min("date").alias("first"))
    assert first.join(last, "user_id").filter(F.date_add("last", 1) != F.col("first")).count() == 0
    assert fc.select("rmse").distinct().count() > 10
    assert {r.model_used for r in fc.select("model_used").distinct().collect()} <= {"seasonal", "Insufficient Data"}
    with pytest.raises(ValueError):
        FC.fit_forecaster(L.txn, model="prophet")


def test_exact_stratified_folds(spark):
    df = spark.range(0, 103).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    f = MD.assign_folds(df, "y", 5, exact=True)
    sizes = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        per = [sizes.get((y, k), 0) for k in range(5)]
        assert max(per) - min(per) <= 1
    assert f.count() == 103 and f.select("id").distinct().count() == 103
    again = {r.id: r.fold for r in MD.assign_folds(df, "y", 5, exact=True).collect()}
    assert again == {r.id: r.fold for r in f.collect()}  # deterministic


def test_predicted_category_is_written(spark, sf_small):
    t = txn_events(spark, sf_small).txn
    cm = MD.fit_category_model(t, num_trees=2, max_depth=3)
    filled = MD.with_predicted_category(cm, t)
    assert filled.columns == t.columns and filled.count() == t.count()
    assert filled.filter(F.col("predicted_category").isNull()).count() == 0
    cats = {r[0] for r in filled.select("predicted_category").distinct().collect()}
    assert cats <= {r[0] for r in t.select("category").distinct().collect()}


def test_corner_case_one_day_two_rows(spark, sf_small):
    # a new user with one day of data still gets predictions, recommendations
    # and explanations (FIXTURES: one-day transactions, income 50000)
    L = txn_events(spark, sf_small)
    models = jobs.train_all(L.txn, L.users, num_trees=2, risk_iters=2, folds=2)
    as_of = D("2025-06-30")
    t = txn_frame(spark, [(1, 77, "2025-06-30", 1000.0, "Food"), (2, 77, "2025-06-30", 500.0, "Transport")])
    u = users_frame(spark, [(77, 50000)])
    pred = jobs.prediction_report(t, u, models, days=30).collect()
    assert len(pred) == 1
    p = pred[0]
    assert len(p.category_predictions) == 2 and p.risk.risk_level == "low" and p.risk.overspend_probability == 0.0
    assert p.forecast.model_used == "Insufficient Data" and len(p.forecast.forecast) == 30
    recs = jobs.recommendation_job(t, u, as_of, models).collect()
    assert {r.rule_id for r in recs} == {"J4a", "J4b"}
    assert all(r.priority in {"low", "medium", "high"} and 0 <= r.confidence <= 1 for r in recs)
    ex = jobs.explain_report(t, u, as_of, models).first()
    assert len(ex.explanations) == len(recs) and all(e.reasoning for e in ex.explanations)


def test_class_balance_summary(spark):
    row = lambda labels: tuple(M.class_balance_summary(spark.createDataFrame([(x,) for x in labels], "label int"), "label").first())
    assert row([1, 0, 0, 1, 0, 0, 0]) == (7, 2, 5, 2, 2, 0.2857)
    assert row([1, 1, 1]) == (3, 3, 0, 1, 0, 1.0)
    assert row([0]) == (1, 0, 1, 1, 0, 0.0)
    assert row([]) == (0, 0, 0, 0, 0, 0.0)
    assert row([None, 1, 0]) == (2, 1, 1, 2, 1, 0.5)


def test_dashboard_lists_the_ten_largest_importances(spark):
    pairs = [(f"feature_{i:02d}", i / 100) for i in range(14)]
    both = MD.global_importances(spark, pairs, [("ratio", 0.5), ("feature_13", 0.13)])
    got = [tuple(r) for r in MD.dashboard_importances(both).collect()]
    assert [r[0] for r in got] == list(range(1, 11))
    assert got[0] == (1, "ratio", 0.5, 100.0) and got[1][1:3] == got[2][1:3] == ("feature_13", 0.13)
    assert got[3][1:] == ("feature_12", 0.12, pytest.approx(36.0)) and got[-1][1] == "feature_06"
