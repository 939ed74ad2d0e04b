"""The stored transactions table: repeatable ingest, whole batches, fixed ids,
copy-on-write, point reads and deep pages."""

import os

import pytest
from helpers import D, txn_frame
from pyspark.sql import functions as F

from ledgerspark import schemas as S
from ledgerspark.operators import summary
from ledgerspark.sources import ledger as LG
from ledgerspark.sources import store as ST
from ledgerspark.sources import versions as V
from ledgerspark.streaming.ingest import start_ingest

AS_OF = D("2025-06-30")


def _raw(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], S.RAW_UPLOAD)


def _row(batch, day=1, amount="5", user="1", category="Food", month="2025-06"):
    return (batch, user, f"{month}-{day:02d}", amount, category)


def _files(table):
    return sorted(os.path.relpath(os.path.join(d, f), table) for d, _, fs in os.walk(table) for f in fs if f.endswith(".parquet") and "segment=" in d)


def _ids(spark, table):
    return sorted(r["id"] for r in LG.transactions(spark, table).collect())


def _opened(df):
    """Files that the scans of ``df`` open."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            n += p.metrics().apply("numFiles").value()
        todo += [p.children().apply(i) for i in range(p.children().length())]
    return n


def test_a_repeated_ingest_adds_nothing(spark, tmp_dir):
    t = f"{tmp_dir}/t"
    raw = _raw(spark, [_row("a"), _row("a", 2), _row("b", 3, "-1"), _row("c", month="2025-05"), _row(None), _row("")])
    first = LG.ingest(raw, t, AS_OF, "upload-1")
    assert LG.ingest(raw, t, AS_OF, "upload-1")["version"] == first["version"] == 1
    assert _ids(spark, t) == [1, 2, 3]
    assert LG.ingest(raw, t, AS_OF, "upload-2")["next_id"] == 7 and _ids(spark, t) == [1, 2, 3, 4, 5, 6]
    reasons = [(r["batch_id"], r["reason"]) for r in LG.rejected_rows(spark, t).collect()]
    assert sorted(reasons, key=str) == sorted([("b", "invalid_row"), (None, "invalid_row"), ("", "invalid_row")] * 2, key=str)
    assert LG.transactions(spark, t).schema.fieldNames() == S.TRANSACTIONS.fieldNames()
    assert V.names(spark, f"{t}/_work") == []


def test_a_repeated_request_adds_nothing(spark, tmp_dir):
    for request in ("r1", "r1", "r2"):
        ST.append_one(spark, 7, {"date": "2025-06-02", "amount": 3, "category": "Food"}, f"{tmp_dir}/t", AS_OF, request)
    assert _ids(spark, f"{tmp_dir}/t") == [1, 2]


def test_a_failed_ingest_leaves_the_table_as_it_was(spark, tmp_dir, monkeypatch):
    t = f"{tmp_dir}/t"
    LG.ingest(_raw(spark, [_row("a")]), t, AS_OF, "one")
    real = V.publish
    monkeypatch.setattr(V, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        LG.ingest(_raw(spark, [_row("b"), _row("c", 2, "x")]), t, AS_OF, "two")
    monkeypatch.setattr(V, "publish", real)
    assert _ids(spark, t) == [1] and LG.rejected_rows(spark, t).count() == 0
    with open(f"{t}/_versions/000000000002.json", "w") as f:  # a version cut off while it was written
        f.write('{"segments": {}')
    assert _ids(spark, t) == [1]
    LG.ingest(_raw(spark, [_row("b"), _row("c", 2, "x")]), t, AS_OF, "two")
    assert _ids(spark, t) == [1, 2] and LG.rejected_rows(spark, t).count() == 1 and LG.state(spark, t)["version"] == 3


def test_two_writers_both_count(spark, tmp_dir, monkeypatch):
    t = f"{tmp_dir}/t"
    real, raced = V.publish, []

    def publish(*a):
        if not raced:  # another job publishes while this one was writing
            raced.append(1)
            LG.ingest(_raw(spark, [_row("other"), _row("other", 2)]), t, AS_OF, "other")
        real(*a)

    monkeypatch.setattr(V, "publish", publish)
    LG.ingest(_raw(spark, [_row("mine", 3)]), t, AS_OF, "mine")
    assert _ids(spark, t) == [1, 2, 3] and sorted(LG.state(spark, t)["ingests"]) == ["mine", "other"]


def test_ids_do_not_depend_on_partitions(spark, tmp_dir):
    rows = [_row(f"b{i % 40}", 1 + i % 28, str(1 + i % 7), str(i % 5)) for i in range(1200)] + [_row("twice")] * 2
    got = []
    for n in (1, 7):
        LG.ingest(_raw(spark, rows).repartition(n), f"{tmp_dir}/t{n}", AS_OF)
        got.append(sorted(tuple(r) for r in LG.transactions(spark, f"{tmp_dir}/t{n}").drop("created_at").collect()))
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(1, 1203))


def test_a_hot_batch_is_rejected_whole(spark, tmp_dir):
    spark.conf.set("spark.ledgerspark.hotGroupRows", "500")
    try:
        LG.ingest(_raw(spark, [_row("big")] * 3000 + [_row("ok")] * 1000), f"{tmp_dir}/t", AS_OF)
    finally:
        spark.conf.unset("spark.ledgerspark.hotGroupRows")
    assert _ids(spark, f"{tmp_dir}/t") == list(range(1, 1001))
    assert {(r["reason"], r["count"]) for r in LG.rejected_rows(spark, f"{tmp_dir}/t").groupBy("reason").count().collect()} == {("batch_too_large", 3000)}


def test_replayed_epochs_and_split_batches(spark, tmp_dir):
    t = f"{tmp_dir}/t"
    epochs = [
        [_row("whole"), _row("split"), _row("bad")],
        [_row("split", 2), _row("bad", 2, "-4"), _row("next", 9)],
        [_row("later", 5)],
        [_row("split", 7)],  # after it was judged
    ]
    seen = []
    for i, rows in enumerate(epochs):
        for _ in range(2):  # every epoch is replayed
            LG.ingest_epoch(_raw(spark, rows), t, AS_OF, "s", i)
        seen.append(LG.transactions(spark, t).count())
    assert seen == [0, 1, 4, 5]  # whole; both rows of split, next; later
    assert {(r["batch_id"], r["reason"]) for r in LG.rejected_rows(spark, t).collect()} == {
        ("bad", "batch_has_invalid_row"), ("bad", "invalid_row"), ("split", "batch_closed")}
    LG.ingest_epoch(_raw(spark, [_row("last")]), t, AS_OF, "s", 4)
    before = LG.close_stream(spark, t, AS_OF, "s")
    assert LG.transactions(spark, t).count() == 6 == len(set(_ids(spark, t)))
    assert LG.close_stream(spark, t, AS_OF, "s")["version"] == before["version"]


def test_an_open_batch_that_is_too_large_does_not_wait(spark, tmp_dir):
    t = f"{tmp_dir}/t"
    for i in range(2):
        LG.ingest_epoch(_raw(spark, [_row("big")] * 600), t, AS_OF, "s", i)
    assert LG.rejected_rows(spark, t).count() == 1200 and LG.state(spark, t)["streams"]["s"]["pending"] is None


def test_streamed_files_of_one_batch(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    for i in range(3):
        with open(f"{tmp_dir}/in/u{i}.csv", "w") as f:
            f.write("batch_id,user_id,date,amount,category,merchant,description\n" + f"s1,3,2025-06-0{i + 1},10,Food,,\n" + f"s{i + 5},4,2025-06-01,1,Rent,,\n")
    q = start_ingest(spark, f"{tmp_dir}/in", f"{tmp_dir}/t", f"{tmp_dir}/ck", AS_OF, files_per_trigger=1, once=True)
    assert q.awaitTermination(120)
    rows = LG.transactions(spark, f"{tmp_dir}/t").collect()
    assert len(rows) == 6 == len({r["id"] for r in rows})
    assert start_ingest(spark, f"{tmp_dir}/in", f"{tmp_dir}/t", f"{tmp_dir}/ck", AS_OF, files_per_trigger=1, once=True).awaitTermination(120)
    assert LG.transactions(spark, f"{tmp_dir}/t").count() == 6


def _table(spark, tmp_dir, users=40, per=12):
    t = f"{tmp_dir}/t"
    rows = [_row(f"b{u}-{m}", 1 + k, str(k + 1), str(u), month=f"2025-{m:02d}") for u in range(users) for m in (3, 4, 5) for k in range(per)]
    spark.conf.set(LG.BUCKET_ROWS_CONF, "30")
    try:
        LG.ingest(_raw(spark, rows), t, AS_OF)
    finally:
        spark.conf.unset(LG.BUCKET_ROWS_CONF)
    return t


def test_replace_and_purge_rewrite_only_what_they_touch(spark, tmp_dir, monkeypatch):
    t = _table(spark, tmp_dir)
    LG.ingest(_raw(spark, [_row("x", user="99", month="2025-06")]), t, AS_OF)
    files, before = _files(t), LG.transactions(spark, t).count()
    april = spark.createDataFrame([(99,)], "user_id long")
    LG.purge(spark, t, april)
    assert LG.transactions(spark, t).where("user_id = 99").count() == 0 and LG.transactions(spark, t).count() == before - 1
    live = {f"segment={s}/year_month={m}" for s, x in LG.state(spark, t)["segments"].items() for m in x["months"]}
    assert sum(f.rsplit("/bucket", 1)[0] in live for f in files) == len(files) - 1  # all but the file of June
    assert set(_files(t)) == set(files)  # nothing was copied
    new = txn_frame(spark, [(0, 7, "2025-06-03", 9.5, "Rent"), (0, 7, "2025-06-03", 9.5, "Rent")])
    monkeypatch.setattr(V, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        LG.replace_users(spark, t, new)
    assert LG.transactions(spark, t).where("user_id = 7").count() == 36
    monkeypatch.undo()
    old = {r["id"]: r["user_id"] for r in LG.transactions(spark, t).collect()}
    LG.replace_users(spark, t, new)
    now = {r["id"]: r["user_id"] for r in LG.transactions(spark, t).collect()}
    assert {i for i, u in old.items() if u != 7} < set(now) and len(now) == len(old) - 36 + 2
    assert sorted(i for i in now if i not in old) == [1442, 1443]
    LG.compact(spark, t)
    assert {r["id"]: r["user_id"] for r in LG.transactions(spark, t).collect()} == now and len(LG.state(spark, t)["segments"]) == 1


def test_reading_one_user_opens_one_bucket(spark, tmp_dir):
    t = _table(spark, tmp_dir)
    everything = _opened(LG.transactions(spark, t))
    one = LG.transactions(spark, t, user_id=5)
    assert everything >= 3 * 10 and _opened(one) == 3  # a file a month
    got = LG.scan_user(spark, t, 5).collect()
    assert len(got) == 36 and [r["date"] for r in got] == sorted(r["date"] for r in got) and got[0]["merchant"] == "Unknown"
    assert LG.scan_user(spark, t, 12345).count() == 0


@pytest.mark.parametrize("skip,limit", [(0, 5), (10, 5), (11, 30), (35, 10), (36, 3), (500, 5), (0, 500)])
def test_deep_pages(spark, tmp_path_factory, skip, limit):
    t = f"{tmp_path_factory.getbasetemp()}/deep"
    if not os.path.exists(t):
        rows = [_row(f"b{u}-{m}", 1 + k // 2, str(k + 1), str(u), month=f"2025-{m:02d}") for u in range(3) for m in (3, 4, 5) for k in range(12)]
        LG.ingest(_raw(spark, rows), t, AS_OF)
    page = LG.user_page(spark, t, 1, skip, limit)
    want = summary.list_page(LG.transactions(spark, t), skip, limit, user_id=1)
    assert [r["id"] for r in page.collect()] == [r["id"] for r in want.collect()]
    assert _opened(page) <= -(-limit // 12) + 1  # the months that the page lies in


def test_buckets_follow_the_rows(spark):
    assert [LG.buckets_for(spark, n, 2) for n in (0, 1, 10**6, 10**6 + 1, 4 * 10**6, 10**12)] == [1, 1, 1, 2, 4, 256]


def test_an_empty_table(spark, tmp_dir):
    t = f"{tmp_dir}/none"
    assert LG.transactions(spark, t).count() == 0 == LG.user_page(spark, t, 1).count()
    LG.ingest(_raw(spark, [_row("a")]).where(F.lit(False)), t, AS_OF)
    LG.purge(spark, t, spark.createDataFrame([(1,)], "user_id long"))
    assert LG.transactions(spark, t).count() == 0 and LG.state(spark, t)["version"] == 2
