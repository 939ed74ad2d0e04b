"""How training sets are laid out for the iterative fits."""

from helpers import txn_frame, users_frame
from ledgerspark.operators import models as MD


def _fitted_frames(monkeypatch):
    frames = []

    def fit(pipe, trains, parallelism, kept=MD.fit_concurrently):
        frames.extend(trains)
        return kept(pipe, trains, parallelism)

    monkeypatch.setattr(MD, "fit_concurrently", fit)
    return frames


def test_large_training_sets_are_dealt_to_cores(spark, monkeypatch):
    monkeypatch.setattr(MD, "ROWS_PER_TASK", 20)
    rows = [(i, 1, f"2025-01-{1 + i % 28:02d}", float(i % 50), "Food" if i % 3 else "Travel", f"m{i % 5}") for i in range(400)]
    frames = _fitted_frames(monkeypatch)
    MD.fit_category_model(txn_frame(spark, rows), num_trees=2, max_depth=2, folds=2)
    cores = spark.sparkContext.defaultParallelism
    assert [f.rdd.getNumPartitions() >= min(cores, 400 // 20) for f in frames] == [True] * 3
    assert frames[0].count() + frames[1].count() == frames[2].count() == 400


def test_folds_are_numbered_once(spark, monkeypatch):
    rows = [(i, i % 4, f"2025-{1 + i % 6:02d}-{1 + i % 9:02d}", 100.0 + 900 * (i % 2), "Food", "m") for i in range(96)]
    frames = _fitted_frames(monkeypatch)
    MD.fit_risk_model(txn_frame(spark, rows), users_frame(spark, [(u, 1000) for u in range(4)]), max_iter=2)
    assert len(frames) > 1
    for f in frames:  # read from a checkpoint: nothing is ranked or joined again in each fit
        plan = f._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_out_of_fold_categories_are_scored_once(spark, monkeypatch):
    from ledgerspark.operators import metrics

    read = []

    def measured(scored, kept=metrics.classification_metrics):
        read.append(scored._jdf.queryExecution().optimizedPlan().toString())
        return kept(scored)

    monkeypatch.setattr(metrics, "classification_metrics", measured)
    rows = [(i, 1, f"2025-01-{1 + i % 28:02d}", float(i % 50), "Food" if i % 3 else "Travel", f"m{i % 5}") for i in range(60)]
    MD.fit_category_model(txn_frame(spark, rows), num_trees=2, max_depth=2, folds=2)
    assert len(read) == 1 and "Python" not in read[0] and "UDF" not in read[0] and "probabilities" not in read[0]
