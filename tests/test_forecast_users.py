"""Per-user forecasts: closed-form ridge, sparse changepoints, band coverage."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import txn_frame, users_frame
from pyspark.sql import functions as F

from ledgerspark.operators import features as FE
from ledgerspark.operators import forecast as FC
from ledgerspark.operators import forecast_users as FU

DAY0 = dt.date(2024, 1, 1)


def _txn(spark, series):
    """series: {user: [amount per day]}"""
    rows = [(0, u, DAY0 + dt.timedelta(days=i), a, "Food") for u, ys in series.items() for i, a in enumerate(ys) if a is not None]
    return txn_frame(spark, [(k, *r[1:]) for k, r in enumerate(rows)])


def _noise(seed, n, base):
    return [round(float(x), 2) for x in base + np.random.default_rng(seed).gamma(2.0, base / 4, n)]


@pytest.mark.parametrize("leak_free", [False, True])
def test_each_user_gets_their_own_closed_form(spark, leak_free):
    t = _txn(spark, {1: _noise(1, 120, 40.0), 2: _noise(2, 70, 90_000.0), 3: _noise(3, 8, 5.0)})
    fm = FC.fit_ridge(t, leak_free=leak_free)
    frame = FC.ridge_training_frame(t, per_user=True, leak_free=leak_free).toPandas().sort_values(["user_id", "ds"])
    table = {r["user_id"]: r for r in fm.pipeline.table.collect()}
    latest = {r["user_id"]: r["prediction"] for r in fm.pipeline.transform(FE.latest_row(spark.createDataFrame(frame), "ds")).collect()}
    for u, rows in frame.groupby("user_id"):
        train = rows if len(rows) == 1 else rows[rows["is_train"]]
        x, y = train[FE.FORECAST_FEATURES].to_numpy(float), train["y"].to_numpy(float)
        xc, yc = x - x.mean(0), y - y.mean()
        coef = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
        intercept = y.mean() - x.mean(0) @ coef
        np.testing.assert_allclose(table[u]["coef"], coef, rtol=1e-3, atol=1e-4)
        last = rows.iloc[-1][FE.FORECAST_FEATURES].to_numpy(float)
        assert latest[u] == pytest.approx(last @ coef + intercept, rel=1e-6)
        test = rows[~rows["is_train"]] if len(rows) > 1 else rows.iloc[:0]
        assert (table[u]["n_train"], table[u]["n_test"]) == (len(train), len(test))
        if len(test):
            err = test[FE.FORECAST_FEATURES].to_numpy(float) @ coef + intercept - test["y"].to_numpy(float)
            assert table[u]["rmse"] == pytest.approx(np.sqrt((err**2).mean()), rel=1e-4, abs=1e-5)
    assert fm.metrics["training_days"] == sum(r["n_train"] for r in table.values())


def test_forecast_records_carry_the_users_own_metrics(spark):
    t = _txn(spark, {1: _noise(1, 120, 40.0), 2: _noise(2, 70, 90_000.0), 4: [1.0] * 3})
    u = users_frame(spark, [(i, 1000) for i in (1, 2, 4)])
    fm = FC.fit_ridge(t, leak_free=True)
    own = {r["user_id"]: r["rmse"] for r in fm.pipeline.table.collect()}
    got = {r["user_id"]: r for r in FC.forecast_summary(FC.forecast_points(fm, t, u, 14), fm, 14).collect()}
    assert got[1]["rmse"] == pytest.approx(own[1], abs=0.006) and got[2]["rmse"] > 100 * got[1]["rmse"]
    assert (got[4]["model_used"], got[4]["rmse"], got[4]["total_predicted"]) == ("Insufficient Data", 0.0, 0.0)


def _broken(rng, n, noise=6.0):
    t = np.arange(n)
    return 100 + 0.2 * t + np.maximum(0, 0.6 * (t - 0.4 * n)) + 8 * np.sin(2 * np.pi * t / 7) + rng.normal(0, noise, n)


def test_a_single_break_keeps_few_changepoints():
    rng = np.random.default_rng(0)
    for n in (120, 300):
        for _ in range(6):
            y = _broken(rng, n)
            fit = FU.SeasonalFit(np.arange(n, dtype=float), y)
            assert 1 <= fit.kept.sum() <= 8 < len(fit.delta) and fit.variance**0.5 * fit.scale == pytest.approx(6, rel=0.3)
            slope = np.cumsum(np.concatenate(([fit.beta[0]], fit.delta))) * fit.scale / fit.span
            assert slope[0] < 0.45 < slope[-1]  # 0.2 before the break, 0.8 after


def test_no_break_keeps_nothing():
    rng = np.random.default_rng(1)
    fit = FU.SeasonalFit(np.arange(200.0), 100 + 0.3 * np.arange(200) + rng.normal(0, 5, 200))
    assert fit.kept.sum() <= 1


def test_l1_path_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a = rng.normal(size=(40, 12)) @ rng.normal(size=(12, 12))
        gram, target, penalty = a.T @ a, a.T @ rng.normal(size=40), 3.0
        d = FU.l1_path(gram, target, penalty)
        slope = target - gram @ d
        scale = np.abs(target).max()
        assert (np.abs(slope[d == 0]) <= penalty + 1e-3 * scale).all()
        np.testing.assert_allclose(slope[d != 0], penalty * np.sign(d[d != 0]), atol=1e-3 * scale)


@pytest.mark.parametrize("kind", ["break", "sparse"])
def test_bands_cover_the_holdout(kind):
    rng = np.random.default_rng(4)
    covered = []
    for _ in range(25):
        if kind == "break":
            n = int(rng.choice([120, 300]))
            days, y = np.arange(n), _broken(rng, n)
        else:  # few, irregular days
            days = np.sort(rng.choice(2000, 50, replace=False))
            y = rng.gamma(2, 20_000, 50)
        ds = pd.Series(pd.Timestamp("2024-01-01") + pd.to_timedelta(days, unit="D"))
        covered.append(FU.fit_series(ds, y, 30, 30)["covered"])
    assert 0.7 <= np.mean(covered) <= 0.92


def test_seasonal_forecasts_of_users(spark):
    rng = np.random.default_rng(5)
    big = [round(float(v) * 1000, 2) for v in _broken(rng, 120)]
    t = _txn(spark, {1: [round(float(v), 2) for v in _broken(rng, 120)], 2: big, 3: [5.0], 4: [7.0, 7.0], 5: [3.0] * 30})
    fm = FC.fit_forecaster(t, "seasonal")
    rows = {r["user_id"]: r for r in fm.pipeline.table.collect()}
    assert sorted(rows) == [1, 2, 4, 5] and rows[2]["sigma"] > 300 * rows[1]["sigma"] and rows[2]["rmse"] > 300 * rows[1]["rmse"]
    pts = FC.seasonal_points_per_user(fm, t, 14)
    got = {r["user_id"]: r for r in FC.forecast_summary(pts, fm, 14).collect()}
    assert {u: r["model_used"] for u, r in got.items()} == {1: "seasonal", 2: "seasonal", 3: "Insufficient Data", 4: "seasonal", 5: "seasonal"}
    assert got[3]["total_predicted"] == 0.0 and all(r["forecast_days"] == 14 for r in got.values())
    assert got[5]["total_predicted"] == pytest.approx(42.0, rel=0.01)
    p = pts.collect()
    assert all(0 <= r["lower_bound"] <= r["predicted_amount"] <= r["upper_bound"] for r in p)
    assert min(r["date"] for r in p if r["user_id"] == 1) == DAY0 + dt.timedelta(days=120)
    wide = {u: np.mean([r["upper_bound"] - r["lower_bound"] for r in p if r["user_id"] == u]) for u in (1, 2)}
    assert wide[2] > 300 * wide[1]
    assert pts.where(F.col("predicted_amount").isNull()).count() == 0


def test_fits_need_no_package_on_the_workers(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps((FU.fit_series, FU._solve(1, 1.0))))
    code = """
import pickle, sys
import numpy as np, pandas as pd
fit, solve = pickle.load(open(sys.argv[1], "rb"))
got = fit(pd.Series(pd.date_range("2024-01-01", periods=40)), np.arange(40.0), 10, 5)
assert "ledgerspark" not in sys.modules and abs(got["mean"][0] - 40) < 2, got["mean"]
"""
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "f")], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_fit_needs_eigenvalues_only_near_singular_sums(monkeypatch):
    """The eigenvalues of every round's sums took most of a user's fit."""
    calls, real = [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda *a, **k: calls.append(1) or real(*a, **k))
    rng = np.random.default_rng(8)
    fit = FU.SeasonalFit(np.arange(60.0), rng.gamma(2, 1000, 60))
    assert not calls
    mean, spread = fit.predict(np.arange(60.0, 70.0))
    FU.SeasonalFit(np.arange(30.0), np.full(30, 3.0))  # a series without noise
    assert calls
    monkeypatch.setattr(FU, "_inverse", lambda gram, least: real(gram, hermitian=True))
    by_eigenvalues = FU.SeasonalFit(np.arange(60.0), np.random.default_rng(8).gamma(2, 1000, 60)).predict(np.arange(60.0, 70.0))
    np.testing.assert_allclose((mean, spread), by_eigenvalues, rtol=1e-9)


def test_a_series_is_fitted_in_date_order(spark):
    rng = np.random.default_rng(4)
    rows = [(u, DAY0 + dt.timedelta(days=d), float(v)) for u in (1, 2) for d, v in enumerate(rng.gamma(2, 100, 40))]
    rows.append((3, DAY0, 5.0))
    want = {u: FU.fit_series(pd.Series([r[1] for r in rows if r[0] == u]), np.array([r[2] for r in rows if r[0] == u]), 10, 5) for u in (1, 2)}
    rng.shuffle(rows)
    got = FU.fit_seasonal_per_user(spark.createDataFrame([(int(u), d, float(v)) for u, d, v in rows], "user_id long, ds date, y double"), 10, 5)
    by = {r["user_id"]: r for r in got.table.collect()}
    assert sorted(by) == [1, 2]
    for u, r in by.items():
        assert r["last_ds"] == DAY0 + dt.timedelta(days=39) and r["n_days"] == 40
        np.testing.assert_allclose(r["mean"], want[u]["mean"], rtol=1e-9)


def test_a_day_without_a_date_is_an_error():
    ds = np.array(["2024-01-01", "2024-01-03", "2024-01-09", "2024-01-12", "NaT"], "datetime64[D]")
    with pytest.raises(np.linalg.LinAlgError):
        FU.fit_series(ds, np.array([1.0, 2, 3, 4, 5]), 30, 5)
