"""The stored transactions table (ops A3-A7, A5 point reads, F1 deep pages).

Layout: ``<table>/segment=<name>/year_month=<month>/bucket=<of>-<n>/*.parquet``. A segment
is what one job wrote; its files never change, and its months are cut into as many user
buckets as its rows need. The published version (``versions``)
lists the segments with their months and buckets, the next row id, the ingests that were
applied and, per stream, the last epoch and the rows of batches still open.

* **Ingest is repeatable.** The version names every applied ``ingest_id`` and the last
  epoch of every stream: a repeated one changes nothing. Data, rejects, open batches and
  the journal entry become visible in one step, or not at all.
* **Ids do not depend on tasks.** Accepted batches are numbered by a running count
  in order of batch id, rows inside a batch (at most 1000) in order of their values:
  computed again after a lost executor, or dealt out anew for writing, a row
  keeps its id. Ids are dense and continue from the last version.
* **A batch is judged whole**, also when its rows come in several triggers: rows wait
  in the version until ``quiet`` triggers passed without a row of their batch (or it
  is larger than a batch may be). Rows that come after that are rejected as ``batch_closed``.
* **Replacing and purging** rewrite only the (segment, month) folders that hold a row
  of the users concerned; all other files keep their names.
* **One user's rows** lie in one bucket per month, sorted by user: a point read opens
  that bucket's files and skips row groups by their minimum and maximum.

Rows of a missing batch id (null or empty) are one batch that is rejected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalars import month_start
from ..operators.filters import null_defaults
from ..operators.metrics import count_before
from ..operators.skew import anti_join, hot_rows_setting
from . import versions as V
from .store import validate_transactions

BUCKET_ROWS, MOST_BUCKETS = 500_000, 256  # rows of a month's bucket (about), buckets of a month
BUCKET_ROWS_CONF = "spark.ledgerspark.bucketRows"
TRIES = 5  # when other jobs publish in between
STORED = T.StructType([T.StructField(f.name, f.dataType, True) for f in S.TRANSACTIONS.fields]
                      + [T.StructField("segment", T.StringType()), T.StructField("year_month", T.StringType()),
                         T.StructField("bucket", T.StringType())])
RAW = [f.name for f in S.RAW_UPLOAD.fields]


# ---------------------------------------------------------------- reading ----


def state(spark: SparkSession, table: str) -> dict:
    """What the newest version says; ``last`` is the highest number in use."""
    last, doc = V.latest(spark, table)
    empty = {"next_id": 1, "segments": {}, "rejected": [], "closed": [], "ingests": [], "streams": {}, "version": 0}
    return {**empty, **(doc or {}), "last": last}


def user_bucket(user_id: Column, buckets: int) -> Column:
    return F.concat(F.lit(f"{buckets}-"), F.pmod(F.xxhash64(user_id.cast("long")), F.lit(buckets)))


def buckets_for(spark: SparkSession, rows: int, months: int) -> int:
    """A power of two, so that a month's bucket holds about ``BUCKET_ROWS`` rows."""
    per = int(spark.conf.get(BUCKET_ROWS_CONF, str(BUCKET_ROWS))) * max(months, 1)
    return min(MOST_BUCKETS, 1 << max(0, -(-rows // per) - 1).bit_length())


def read_table(spark: SparkSession, table: str, months: list[str] | None = None, user_id: int | None = None,
               version: dict | None = None) -> DataFrame:
    """The published rows, with ``segment``, ``year_month`` and ``bucket``. ``months`` names the
    folders to look at; ``user_id`` prunes to the user's bucket."""
    v = version or state(spark, table)
    paths = [f"{table}/segment={s}/year_month={m}" for s, ms in sorted(v["segments"].items()) for m in ms["months"] if months is None or m in months]
    rows = spark.read.schema(STORED).option("basePath", table).parquet(*paths) if paths else spark.createDataFrame([], STORED)
    if user_id is not None:
        key = F.lit(user_id).cast("long")
        # constants, so that they prune folders
        of = [F.col("bucket") == user_bucket(key, b) for b in sorted({x["buckets"] for x in v["segments"].values()})]
        rows = rows.where(reduce(lambda a, b: a | b, of, F.lit(False)) & (F.col("user_id") == key))
    return rows


def transactions(spark: SparkSession, table: str, **kw) -> DataFrame:
    """The published rows as ``transactions``."""
    return read_table(spark, table, **kw).select(*S.TRANSACTIONS.fieldNames())


def rejected_rows(spark: SparkSession, table: str) -> DataFrame:
    """The published rejects with their reasons (None of them: an empty frame)."""
    paths = [f"{table}/_rejected/segment={s}" for s in state(spark, table)["rejected"]]
    schema = T.StructType([*S.RAW_UPLOAD.fields, T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def scan_user(spark: SparkSession, table: str, user_id: int) -> DataFrame:
    """A5 on the stored table: one user's frame in date order."""
    return null_defaults(transactions(spark, table, user_id=user_id)).orderBy("date", "id")


def user_page(spark: SparkSession, table: str, user_id: int, skip: int = 0, limit: int = S.LIST_DEFAULT_LIMIT) -> DataFrame:
    """F1 for one user at any depth: rows by date, then id, descending. The user's rows
    are counted per month (the page directory, one number a month); only the
    months that the page lies in are read and sorted."""
    if skip < 0 or not (1 <= limit <= S.LIST_MAX_LIMIT):
        raise ValueError("skip must be >= 0 and limit in 1..500")
    v = state(spark, table)
    per = read_table(spark, table, user_id=user_id, version=v).groupBy("year_month").agg(F.count(F.lit(1)).alias("n")).collect()
    months, before, offset = [], 0, 0
    for r in sorted(per, key=lambda r: r["year_month"], reverse=True):
        if before + r["n"] > skip and before < skip + limit:
            offset = offset if months else skip - before
            months.append(r["year_month"])
        before += r["n"]
    rows = transactions(spark, table, months=months, user_id=user_id, version=v)
    return rows.orderBy(F.desc("date"), F.desc("id")).offset(offset).limit(limit)


# ---------------------------------------------------------------- writing ----


def _write_segment(rows: DataFrame, table: str, segment: str, buckets: int) -> dict:
    """``rows`` as a segment; its months and buckets. Rebalancing splits a hot user's bucket and
    joins small ones by measured sizes."""
    rows = rows.select(*S.TRANSACTIONS.fieldNames()).withColumns(
        {"year_month": F.date_format(month_start("date"), "yyyy-MM"), "bucket": user_bucket(F.col("user_id"), buckets)}
    )
    rows = rows.hint("rebalance", "year_month", "bucket").sortWithinPartitions("year_month", "bucket", "user_id", "date", "id")
    rows.write.partitionBy("year_month", "bucket").parquet(f"{table}/segment={segment}")
    months = [n.partition("=")[2] for n in V.names(rows.sparkSession, f"{table}/segment={segment}") if n.startswith("year_month=")]
    return {"months": months, "buckets": buckets}


def _publish(spark: SparkSession, table: str, change: Callable[[dict], dict | None]) -> dict:
    """Compute and publish ``change(state)``; again on the newer state if another job was
    faster. None from ``change`` publishes nothing."""
    for _ in range(TRIES):
        now = state(spark, table)
        new = change(now)
        if new is None:
            return now
        new.pop("last", None)
        try:
            V.publish(spark, table, now["last"] + 1, new)
        except V.VersionConflict:
            continue
        return {**new, "version": now["last"] + 1, "last": now["last"] + 1}
    raise V.VersionConflict(f"{TRIES} versions of {table} were published by others")


def _checked(rows: DataFrame, as_of: dt.date, path: str) -> DataFrame:
    """Validated rows, written once: all later steps read them."""
    key = F.coalesce("batch_id", F.lit(""))
    v = validate_transactions(rows, as_of).withColumn("_key", key)
    v = v.withColumn("errors", F.when(key == "", F.array_append("errors", F.lit("batch_id"))).otherwise(F.col("errors")))
    v.withColumn("valid", F.size("errors") == 0).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _verdicts(checked: DataFrame, ready: Column) -> DataFrame:
    """One row a batch: rows, last trigger, ready, accepted, and ids given to batches before it."""
    n = F.col("batch_rows")
    per = checked.groupBy("_key").agg(F.count(F.lit(1)).alias("batch_rows"), F.bool_and("valid").alias("all_valid"), F.max("_seen").alias("last_seen"))
    per = per.withColumn("ready", ready | (n > S.BATCH_MAX_ROWS))
    ok = F.col("ready") & F.col("all_valid") & (n >= S.BATCH_MIN_ROWS) & (n <= S.BATCH_MAX_ROWS)
    return count_before(per.withColumn("accepted", ok).withColumn("_take", F.when(ok, n).otherwise(F.lit(0))), "_key", "_take")


def _accepted_rows(checked: DataFrame, verdicts: DataFrame, next_id: int) -> DataFrame:
    """Accepted rows with their ids. Batches far too large to be accepted are taken out
    first by a broadcast list (at most rows / limit of them), so no key of the join is hot."""
    limit = max(hot_rows_setting(checked), S.BATCH_MAX_ROWS)
    hot = verdicts.where(F.col("batch_rows") > F.lit(limit)).select("_key")
    rows = checked.where("valid").join(F.broadcast(hot), "_key", "left_anti")
    rows = rows.join(verdicts.where("accepted").select("_key", "before"), "_key")
    inside = Window.partitionBy("_key").orderBy("parsed_date", "parsed_amount", "category", "merchant", "description", "user_id")
    return rows.withColumn("_at", F.row_number().over(inside)).select(
        (F.lit(next_id - 1) + F.col("before") + F.col("_at")).cast("long").alias("id"),
        F.trim("user_id").try_cast("long").alias("user_id"), F.col("parsed_date").alias("date"), F.col("parsed_amount").alias("amount"),
        "category", "merchant", "description", F.lit(None).cast("string").alias("predicted_category"), F.current_timestamp().alias("created_at"),
    )


def _of_batches(checked: DataFrame, keys: DataFrame, rows_col: str = "batch_rows") -> DataFrame:
    """Rows of the batches in ``keys``, a hot batch spread over tasks."""
    from ..operators.skew import join_back

    return join_back(checked.withColumn("_spread", F.monotonically_increasing_id()), keys, ["_key"], rows_col).drop("_spread")


def _apply(spark: SparkSession, table: str, now: dict, checked: DataFrame, ready: Column, closed: DataFrame | None,
           rejected_path: str | None, stream: str | None = None) -> dict:
    """The state after judging the ready batches of ``checked``; their files are written,
    not yet published."""
    segment = V.new_name()
    late = None
    if closed is not None:  # rows of batches that were judged before
        late = checked.join(closed.select("_key").distinct(), "_key", "left_semi")
        checked = checked.join(closed.select("_key").distinct(), "_key", "left_anti")
    verdicts = _verdicts(checked, ready)
    totals = verdicts.agg(
        F.coalesce(F.sum("_take"), F.lit(0)).alias("rows"), F.count_if("ready").alias("ready"), F.count_if("accepted").alias("accepted"),
        F.count(F.lit(1)).alias("batches"),
    ).first()
    new = {**now, "segments": dict(now["segments"]), "rejected": list(now["rejected"]), "closed": list(now["closed"])}
    if totals["rows"]:
        span = checked.where("valid").agg(F.min("parsed_date").alias("a"), F.max("parsed_date").alias("z")).first()
        months = (span["z"].year - span["a"].year) * 12 + span["z"].month - span["a"].month + 1
        buckets = buckets_for(spark, totals["rows"], months)
        new["segments"][segment] = _write_segment(_accepted_rows(checked, verdicts, now["next_id"]), table, segment, buckets)
        new["next_id"] = now["next_id"] + totals["rows"]
    out = []
    if totals["ready"] > totals["accepted"]:
        bad = _of_batches(checked, verdicts.where("ready and not accepted").select("_key", "batch_rows"))
        out.append(bad.withColumn("reason", F.when(F.col("batch_rows") > S.BATCH_MAX_ROWS, F.lit("batch_too_large"))
                                  .when(~F.col("valid"), F.lit("invalid_row")).otherwise(F.lit("batch_has_invalid_row"))))
    if late is not None and not late.isEmpty():
        out.append(late.withColumn("reason", F.lit("batch_closed")))
    if out:
        to = rejected_path or f"{table}/_rejected"
        for i, rows in enumerate(out):
            rows.select(*RAW, "errors", "reason").write.mode("append" if i else "errorifexists").parquet(f"{to}/segment={segment}")
        if not rejected_path:
            new["rejected"].append(segment)
    if stream is not None:
        if totals["ready"]:
            verdicts.where("ready").select(F.lit(stream).alias("stream"), "_key", "accepted", "batch_rows").write.parquet(
                f"{table}/_closed/segment={segment}")
            new["closed"].append(segment)
        open_batches = totals["batches"] - totals["ready"]
        if open_batches:
            _of_batches(checked, verdicts.where("not ready").select("_key", "batch_rows")).select(*RAW, "_seen").write.parquet(
                f"{table}/_pending/segment={segment}")
        new["streams"] = {**now["streams"], stream: {**now["streams"].get(stream, {"epoch": -1}), "pending": segment if open_batches else None}}
    return new


def ingest(raw: DataFrame, table: str, as_of: dt.date, ingest_id: str | None = None, rejected_path: str | None = None) -> dict:
    """A3: judge every batch of ``raw`` and publish the accepted rows. The same ``ingest_id``
    is applied once, however often the job is run. Returns the published state."""
    spark = raw.sparkSession
    table = table.rstrip("/")
    ingest_id = ingest_id or V.new_name()
    work = f"{table}/_work/{V.new_name()}"
    if ingest_id in state(spark, table)["ingests"]:
        return state(spark, table)
    try:
        checked = _checked(raw.select(*RAW).withColumn("_seen", F.lit(0).cast("long")), as_of, f"{work}/checked")

        def change(now: dict) -> dict | None:
            if ingest_id in now["ingests"]:
                return None
            new = _apply(spark, table, now, checked, F.lit(True), None, rejected_path)
            return {**new, "ingests": [*now["ingests"], ingest_id]}

        return _publish(spark, table, change)
    finally:
        V.remove(spark, work)


def _closed_batches(spark: SparkSession, table: str, now: dict, stream: str) -> DataFrame | None:
    paths = [f"{table}/_closed/segment={s}" for s in now["closed"]]
    return spark.read.parquet(*paths).where(F.col("stream") == F.lit(stream)).select("_key") if paths else None


def _stream_change(spark: SparkSession, table: str, raw: DataFrame | None, as_of: dt.date, stream: str, epoch: int | None,
                   quiet: int, rejected_path: str | None) -> dict:
    """Judge what is ready among the open batches and ``raw``; ``epoch`` None judges all that is open."""
    work = f"{table}/_work/{V.new_name()}"
    tried = iter(range(TRIES))

    def change(now: dict) -> dict | None:
        at = now["streams"].get(stream, {"epoch": -1, "pending": None})
        if epoch is not None and epoch <= at["epoch"] or epoch is None and not at["pending"]:
            return None
        parts = [spark.read.parquet(f"{table}/_pending/segment={at['pending']}")] if at["pending"] else []
        if raw is not None:
            parts.append(raw.select(*RAW).withColumn("_seen", F.lit(epoch).cast("long")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        checked = _checked(rows, as_of, f"{work}/checked-{next(tried)}")
        ready = F.lit(True) if epoch is None else F.col("last_seen") <= F.lit(epoch - quiet)
        new = _apply(spark, table, now, checked, ready, _closed_batches(spark, table, now, stream), rejected_path, stream)
        if epoch is not None:
            new["streams"][stream]["epoch"] = epoch
        return new

    try:
        return _publish(spark, table, change)
    finally:
        V.remove(spark, work)


def ingest_epoch(raw: DataFrame, table: str, as_of: dt.date, stream: str, epoch: int, quiet: int = 1, rejected_path: str | None = None) -> dict:
    """A3 for one trigger of a stream. A replayed epoch changes nothing."""
    return _stream_change(raw.sparkSession, table.rstrip("/"), raw, as_of, stream, epoch, quiet, rejected_path)


def close_stream(spark: SparkSession, table: str, as_of: dt.date, stream: str, rejected_path: str | None = None) -> dict:
    """Judge the batches that are still open, as when a stream has ended."""
    return _stream_change(spark, table.rstrip("/"), None, as_of, stream, None, 0, rejected_path)


# ------------------------------------------------------- replace and purge ----


def rewrite_users(spark: SparkSession, table: str, users: DataFrame, new_rows: DataFrame | None = None) -> dict:
    """A6 / A7 on the stored table: drop every row of ``users`` (and add ``new_rows``) in one
    published step. Only folders that hold such a row are rewritten, by copy."""
    table = table.rstrip("/")
    ids = users.select("user_id").distinct()

    def change(now: dict) -> dict:
        rows = read_table(spark, table, version=now)
        # a row per folder: bounded by segments and months
        touched = sorted((r["segment"], r["year_month"]) for r in rows.select("user_id", "segment", "year_month").distinct()
                         .join(ids, "user_id", "left_semi").select("segment", "year_month").distinct().collect())
        old = now["segments"]
        new = {**now, "segments": {s: {**x, "months": [m for m in x["months"] if (s, m) not in set(touched)]} for s, x in old.items()}}
        if touched:
            part = {**now, "segments": {}}
            for s, m in touched:
                part["segments"].setdefault(s, {**old[s], "months": []})["months"].append(m)
            kept = anti_join(read_table(spark, table, version=part).drop("segment", "year_month", "bucket"), ids, ["user_id"])
            segment = V.new_name()
            new["segments"][segment] = _write_segment(kept, table, segment, max(x["buckets"] for x in part["segments"].values()))
        if new_rows is not None:
            segment = V.new_name()
            order = F.struct(*sorted(new_rows.columns), F.monotonically_increasing_id().alias("_place"))  # equal rows differ in it alone
            at = count_before(new_rows.withColumn("_order", order).withColumn("_one", F.lit(1)), "_order", "_one")
            numbered = at.withColumn("id", F.lit(now["next_id"]) + F.col("before"))
            size = new_rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(month_start("date")).alias("months")).first()
            new["segments"][segment] = _write_segment(numbered, table, segment, buckets_for(spark, size["rows"], size["months"]))
            new["next_id"] = now["next_id"] + size["rows"]
        new["segments"] = {s: x for s, x in new["segments"].items() if x["months"]}
        return new

    return _publish(spark, table, change)


def replace_users(spark: SparkSession, table: str, new_rows: DataFrame) -> dict:
    """The users of ``new_rows`` lose their old rows and get these, with new ids."""
    return rewrite_users(spark, table, new_rows, new_rows)


def purge(spark: SparkSession, table: str, removed: DataFrame) -> dict:
    """The rows of removed users go."""
    return rewrite_users(spark, table, removed)


def compact(spark: SparkSession, table: str) -> dict:
    """All published rows as one segment, rows and ids unchanged: fewer, larger files."""
    table = table.rstrip("/")

    def change(now: dict) -> dict | None:
        if len(now["segments"]) < 2:
            return None
        segment = V.new_name()
        size = read_table(spark, table, version=now).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("year_month").alias("months")).first()
        rows = read_table(spark, table, version=now).drop("segment", "year_month", "bucket")
        return {**now, "segments": {segment: _write_segment(rows, table, segment, buckets_for(spark, size["rows"], size["months"]))}}

    return _publish(spark, table, change)
