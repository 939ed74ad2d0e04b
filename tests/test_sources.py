"""Sources, sinks and table maintenance (ops A1-A11)."""

import os

import pytest
from helpers import D, txn_frame, users_frame
from ledgerspark import schemas as S
from ledgerspark.sources import files as IO
from ledgerspark.sources import store as ST
from ledgerspark.streaming.ingest import start_ingest

AS_OF = D("2025-06-30")


def _raw(spark, rows):
    return spark.createDataFrame(rows, S.RAW_UPLOAD)


def test_validation_rules(spark):
    rows = [
        ("b1", "1", "2025-06-01", "10.5", "Food", "m", None),
        ("b1", "1", "2025-07-01", "10", "Food", None, None),  # future
        ("b2", "1", "2025-06-01", "-500", "Food", None, None),  # negative amount
        ("b3", "1", "2025-06-01", "x", "Food", None, None),  # not a number
        ("b4", "1", "06/01/2025", "1", "Food", None, None),  # bad date
        ("b5", "1", "2025-06-01", "1", "Coffee", None, None),  # not a category
        ("b6", "1", "2025-06-01", "1", "Food", "m" * 256, None),  # merchant too long
        ("b7", "1", "2025-06-01", "1", "Food", None, "d" * 501),  # description too long
        ("b8", "1", "2025-06-01", "1", "Food", "<b>tag</b>", "<i>x</i>"),  # markup stays text
        ("b9", "1", "2025-06-01", "NaN", "Food", None, None),  # not a number either
        ("b10", "x1", "2025-06-01", "1", "Food", None, None),  # bad user id: rejected, no failure
    ]
    v = {(r.batch_id, r.date): r for r in ST.validate_transactions(_raw(spark, rows), AS_OF).collect()}
    assert v[("b1", "2025-06-01")].valid and v[("b1", "2025-07-01")].errors == ["future_date"]
    assert v[("b2", "2025-06-01")].errors == ["amount"] and v[("b3", "2025-06-01")].errors == ["amount"]
    assert v[("b4", "06/01/2025")].errors == ["date"] and v[("b5", "2025-06-01")].errors == ["category"]
    assert v[("b6", "2025-06-01")].errors == ["merchant_length"]
    assert v[("b7", "2025-06-01")].errors == ["description_length"]
    assert v[("b8", "2025-06-01")].valid
    assert v[("b9", "2025-06-01")].errors == ["amount"]
    assert v[("b10", "2025-06-01")].errors == ["user_id"]
    acc, rej = ST.accept_batches(_raw(spark, rows), AS_OF)
    assert "b10" not in {r.batch_id for r in acc.select("batch_id").distinct().collect()}


def test_batches_are_all_or_nothing_and_bounded(spark):
    good = [("ok", "1", "2025-06-01", "1", "Food", None, None)] * 1000
    big = [("big", "1", "2025-06-01", "1", "Food", None, None)] * 1001
    bad = [("bad", "1", "2025-06-01", "1", "Food", None, None), ("bad", "1", "2025-06-01", "-1", "Food", None, None)]
    acc, rej = ST.accept_batches(_raw(spark, good + big + bad), AS_OF)
    assert {r.batch_id for r in acc.select("batch_id").distinct().collect()} == {"ok"}
    assert acc.count() == 1000
    reasons = {(r.batch_id, r.reason) for r in rej.select("batch_id", "reason").distinct().collect()}
    assert ("big", "batch_too_large") in reasons
    assert ("bad", "invalid_row") in reasons and ("bad", "batch_has_invalid_row") in reasons


def test_bulk_ingest_and_append_one(spark, tmp_dir):
    table = os.path.join(tmp_dir, "txn")
    ST.bulk_ingest(_raw(spark, [("b", "7", "2025-06-01", "12.5", "Rent", "Landlord", None),
                                ("b", "7", "2025-05-01", "2", "Food", "", None)]), table, AS_OF,
                   os.path.join(tmp_dir, "rej"))
    ST.append_one(spark, 7, {"date": "2025-06-02", "amount": 3, "category": "Food"}, table, AS_OF)
    t = spark.read.parquet(table)
    assert t.count() == 3 and t.select("id").distinct().count() == 3
    assert set(r.year_month for r in t.select("year_month").distinct().collect()) == {"2025-05", "2025-06"}


def test_csv_round_trip(spark, tmp_dir):
    t = txn_frame(spark, [(1, 1, "2025-06-01", 10.25, "Food", "A", None), (2, 1, "2025-06-02", 3.0, "Rent", None, "x")])
    path = os.path.join(tmp_dir, "csv")
    IO.csv_sink(t, path)
    back = IO.typed_csv(IO.csv_source(spark, path, user_id=1, batch_id="u1")).orderBy("date").collect()
    assert [(r.date, r.amount, r.category, r.merchant, r.description) for r in back] == [
        (D("2025-06-01"), 10.25, "Food", "A", None), (D("2025-06-02"), 3.0, "Rent", None, "x")]


def test_metrics_document(spark, tmp_dir):
    path = os.path.join(tmp_dir, "metrics")
    assert IO.metrics_source(spark, path) == {}
    m = IO.merge_metrics({"a": 1.0, "model_type": "ridge"}, {"a": 2.0, "n": 3})
    IO.metrics_sink(spark, m, path)
    back = IO.metrics_source(spark, path)
    assert back["a"] == 2.0 and back["n"] == 3 and back["model_type"] == "ridge"


def test_model_store_round_trip(spark, tmp_dir, sf_small):
    from ledgerspark.operators import models as MD
    from ledgerspark.sources.adapters import txn_events

    t = txn_events(spark, sf_small).txn
    cm = MD.fit_category_model(t, num_trees=2, max_depth=2)
    path = os.path.join(tmp_dir, "models")
    IO.save_models(path, {"category": cm.pipeline, "merchant_index": cm.merchant_index}, {"k": 1})
    loaded, meta = IO.load_models(spark, path, ["category", "merchant_index", "risk"])
    assert loaded["risk"] is None and meta == {"k": 1}
    again = MD.CategoryModel(loaded["category"], loaded["merchant_index"])
    a = MD.predict_category(cm, t).select("id", "predicted_category").orderBy("id").collect()
    b = MD.predict_category(again, t).select("id", "predicted_category").orderBy("id").collect()
    assert a == b


def test_equal_purchases_get_two_ids(spark, tmp_dir):
    table = os.path.join(tmp_dir, "single")
    for merchant in ("A cafe", "B cafe"):
        ST.append_one(spark, 1, {"date": "2024-01-02", "amount": 5, "category": "Food", "merchant": merchant}, table, AS_OF)
    rows = spark.read.parquet(table).collect()
    assert len(rows) == 2 and len({r.id for r in rows}) == 2


def test_damaged_store_is_not_taken_for_a_missing_one(spark, tmp_dir):
    bad = os.path.join(tmp_dir, "models", "category")
    os.makedirs(bad)
    with pytest.raises(Exception):  # noqa: B017 - any reading error, but an error
        IO.load_models(spark, os.path.join(tmp_dir, "models"), ["category"])


def test_replace_and_purge(spark):
    t = txn_frame(spark, [(1, 1, "2025-06-01", 1.0, "Food"), (2, 2, "2025-06-01", 2.0, "Food")])
    new = txn_frame(spark, [(3, 1, "2025-06-03", 9.0, "Rent")])
    r = ST.replace_user_rows(t, new)
    assert sorted(x.id for x in r.collect()) == [2, 3]
    u = users_frame(spark, [(1, 10), (2, 20)])
    u2, t2 = ST.purge_users(u, t, u.filter("user_id = 2"))
    assert [x.user_id for x in u2.collect()] == [1] and [x.id for x in t2.collect()] == [1]


def test_register_users(spark):
    u = users_frame(spark, [(5, 100)])  # email u5@example.com
    batch = spark.createDataFrame(
        [("new@x.com", "N", 50.0, None, 1), ("new@x.com", "dup", 60.0, None, 2), ("NEW@x.com", "other", 60.0, None, 2), ("u5@example.com", "e", 1.0, None, 3),
         ("neg@x.com", "n", -1.0, None, 4), ("b@x.com", "B", 70.0, "USD", 5)],
        "email string, full_name string, monthly_income double, currency string, seq long",
    )
    out, rej = ST.register_users(u, batch)
    got = {r.email: r for r in out.collect()}
    assert got["new@x.com"].user_id == 6 and got["new@x.com"].currency == "INR"
    assert got["NEW@x.com"].user_id == 7  # e-mails are compared exactly
    assert got["b@x.com"].user_id == 8 and got["b@x.com"].currency == "USD"
    assert {(r.email, r.reason) for r in rej.collect()} == {
        ("new@x.com", "duplicate_in_batch"), ("u5@example.com", "email_exists"), ("neg@x.com", "income")}


def test_streaming_ingest(spark, tmp_dir):
    in_dir = os.path.join(tmp_dir, "in")
    os.makedirs(in_dir)
    with open(os.path.join(in_dir, "u1.csv"), "w") as f:
        f.write("batch_id,user_id,date,amount,category,merchant,description\n")
        f.write("s1,3,2025-06-01,10,Food,,\n")
        f.write("s1,3,2025-06-02,5,Rent,Home,\n")
    with open(os.path.join(in_dir, "u2.csv"), "w") as f:
        f.write("batch_id,user_id,date,amount,category,merchant,description\n")
        f.write("s2,3,2025-06-01,-1,Food,,\n")
    table = os.path.join(tmp_dir, "t")
    q = start_ingest(spark, in_dir, table, os.path.join(tmp_dir, "ck"), as_of=AS_OF,
                     rejected_path=os.path.join(tmp_dir, "rej"), once=True)
    q.awaitTermination(120)
    t = spark.read.parquet(table)
    assert t.count() == 2
    assert spark.read.parquet(os.path.join(tmp_dir, "rej")).count() == 1


def test_csv_columns_by_header_name(spark, tmp_dir):
    import pytest

    path = os.path.join(tmp_dir, "up.csv")
    with open(path, "w") as f:
        f.write("category,amount,date\n")
        f.write("Food,12.5,2025-06-01\n")
        f.write("\n")
        f.write("Rent,100,2025-06-02\n")
    rows = IO.typed_csv(IO.csv_source(spark, path, batch_id="b")).orderBy("date").collect()
    assert [(r.date, r.amount, r.category, r.merchant) for r in rows] == [
        (D("2025-06-01"), 12.5, "Food", None), (D("2025-06-02"), 100.0, "Rent", None)]
    bad = os.path.join(tmp_dir, "bad.csv")
    with open(bad, "w") as f:
        f.write("date,amount\n2025-06-01,1\n")
    with pytest.raises(ValueError):
        IO.csv_source(spark, bad)


def test_a_crash_between_two_models_leaves_the_old_set(spark, tmp_dir):
    from ledgerspark.operators.forecast_users import UserRidge

    class Broken:
        def save(self, path):
            raise OSError("lost")

    def table(x):
        return UserRidge(spark.createDataFrame([(1, [x], 0.5)], "user_id long, coef array<double>, intercept double"), ["f"])

    path = os.path.join(tmp_dir, "store")
    assert IO.load_models(spark, path, ["forecast"]) == ({"forecast": None}, {})
    IO.save_models(path, {"forecast": table(1.0), "risk": None}, {"k": 1})
    with pytest.raises(OSError):
        IO.save_models(path, {"forecast": table(2.0), "risk": Broken()}, {"k": 2})
    models, meta = IO.load_models(spark, path, ["forecast", "risk"])
    assert models["risk"] is None and meta == {"k": 1} and models["forecast"].table.first()["coef"] == [1.0]
    IO.save_models(path, {"forecast": table(3.0)}, {"k": 3})
    models, meta = IO.load_models(spark, path, ["forecast"])
    assert meta == {"k": 3} and models["forecast"].table.first()["coef"] == [3.0]
