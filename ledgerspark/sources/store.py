"""Table maintenance (ops A2-A8, C6, H17, H21).

Validation is a set of rule columns turned into an array of error codes;
batch acceptance is a grouped aggregate per ``batch_id`` (all-or-nothing,
1..1000 rows) joined back with hot batches salted (``skew.join_back``), so
a huge batch never sits in one task. The stored table itself (journal, ids,
copy-on-write) is in ``ledger``. Removal and replacement are
anti-joins, which keep the work distributed and need no row-level delete.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import parse_amount, parse_date
from ..operators.skew import anti_join, join_back


def validate_transactions(raw: DataFrame, as_of: dt.date) -> DataFrame:
    """A2: per row, the list of broken rules (empty when valid):
    ``date`` (missing or unparsable), ``future_date`` (after ``as_of``),
    ``amount`` (missing, unparsable, NaN or <= 0), ``category`` (not one of the
    16), ``merchant_length`` (> 255), ``description_length`` (> 500),
    ``user_id`` (missing or not a number; a bad row never fails the job)."""
    d = parse_date("date")
    a = parse_amount("amount")
    errors = F.array_compact(
        F.array(
            F.when(d.isNull(), F.lit("date")),
            F.when(d > F.lit(as_of), F.lit("future_date")),
            # NaN sorts above every number in Spark, so it is rejected explicitly
            F.when(a.isNull() | F.isnan(a) | (a <= 0), F.lit("amount")),
            F.when(~F.coalesce(F.col("category").isin(S.CATEGORIES), F.lit(False)), F.lit("category")),
            F.when(F.char_length("merchant") > S.MERCHANT_MAX_CHARS, F.lit("merchant_length")),
            F.when(F.char_length("description") > S.DESCRIPTION_MAX_CHARS, F.lit("description_length")),
            F.when(F.trim(F.col("user_id")).try_cast("long").isNull(), F.lit("user_id")),
        )
    )
    return raw.withColumns(
        {"parsed_date": d, "parsed_amount": a, "errors": errors}
    ).withColumn("valid", F.size("errors") == 0)


def accept_batches(raw: DataFrame, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """A3: a batch is accepted when it has 1..1000 rows and every row is
    valid; one bad row rejects the whole batch. Returns (accepted rows,
    typed like ``transactions`` minus id/created_at; rejected rows with the
    reason)."""
    v = validate_transactions(raw, as_of)
    per_batch = v.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("batch_rows"),
        F.bool_and("valid").alias("all_valid"),
    )
    ok = (
        F.col("all_valid")
        & (F.col("batch_rows") >= S.BATCH_MIN_ROWS)
        & (F.col("batch_rows") <= S.BATCH_MAX_ROWS)
    )
    j = join_back(v, per_batch.withColumn("accepted", ok), ["batch_id"], "batch_rows")
    accepted = j.filter("accepted").select(
        "batch_id",
        F.trim(F.col("user_id")).try_cast("long").alias("user_id"),
        F.col("parsed_date").alias("date"),
        F.col("parsed_amount").alias("amount"),
        "category",
        "merchant",
        "description",
    )
    rejected = j.filter(~F.col("accepted")).select(
        "batch_id",
        "user_id",
        "date",
        "amount",
        "category",
        "merchant",
        "description",
        "errors",
        F.when(F.col("batch_rows") > S.BATCH_MAX_ROWS, F.lit("batch_too_large"))
        .when(~F.col("valid"), F.lit("invalid_row"))
        .otherwise(F.lit("batch_has_invalid_row"))
        .alias("reason"),
    )
    return accepted, rejected


def bulk_ingest(
    raw: DataFrame,
    table_path: str,
    as_of: dt.date,
    rejected_path: str | None = None,
    ingest_id: str | None = None,
) -> dict:
    """A3: validate, keep whole valid batches, publish them in the stored table
    (``ledger.ingest``); rejects go to a side table. A job that names its
    ``ingest_id`` may be repeated: it is applied once."""
    from .ledger import ingest

    return ingest(raw, table_path, as_of, ingest_id, rejected_path)


def append_one(spark, user_id: int, record: dict, table_path: str, as_of: dt.date, request_id: str | None = None) -> dict:
    """A4: one transaction = a one-row batch. A repeated ``request_id`` adds nothing."""
    row = {
        "batch_id": f"single-{user_id}",
        "user_id": str(user_id),
        **{k: (None if record.get(k) is None else str(record.get(k)))
           for k in ("date", "amount", "category", "merchant", "description")},
    }
    raw = spark.createDataFrame([row], S.RAW_UPLOAD)
    return bulk_ingest(raw, table_path, as_of, ingest_id=request_id)


def replace_user_rows(txn: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Drop every existing row of the users present in ``new_rows`` and
    add the new rows."""
    kept = anti_join(txn, new_rows.select("user_id"), ["user_id"])
    return kept.unionByName(new_rows, allowMissingColumns=True)


def purge_users(users: DataFrame, txn: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removing users removes their transactions (cascade)."""
    ids = removed.select("user_id").distinct()
    # users: one row per user; transactions: a hot user's rows are salted
    return users.join(ids, "user_id", "left_anti"), anti_join(txn, ids, ["user_id"])


def register_users(users: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A8 + C6: add users from ``batch`` (email, full_name, monthly_income,
    currency[, seq]). Within the batch the first row per e-mail wins
    (lowest ``seq``, a grouped ``min_by``); e-mails already registered are
    rejected (anti-join); income must be > 0; currency defaults to INR. New
    ids continue after the largest existing id, numbered in ``seq`` order by
    a distributed running count. Returns (users with the new ones, rejects)."""
    from ..operators.metrics import count_before

    b = batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())
    b = b.withColumn("email_key", F.col("email"))
    keep = [c for c in b.columns if c != "email_key"]
    first = b.groupBy("email_key").agg(F.min_by(F.struct(*keep), "seq").alias("r")).select("email_key", "r.*")
    existing = users.select(F.col("email").alias("email_key"))
    fresh = first.join(existing, "email_key", "left_anti")
    ok = F.col("monthly_income").isNotNull() & (F.col("monthly_income") > 0)
    base = users.agg(F.coalesce(F.max("user_id"), F.lit(0)).alias("b")).first()["b"]
    numbered = count_before(fresh.filter(ok).withColumn("_one", F.lit(1)), "seq", "_one")
    new_users = numbered.select(
        (F.lit(int(base) + 1) + F.col("before")).cast("long").alias("user_id"),
        F.col("email"),
        F.col("full_name").cast("string"),
        F.col("monthly_income").cast("double"),
        F.coalesce(F.col("currency"), F.lit(S.DEFAULT_CURRENCY)).alias("currency"),
        F.current_timestamp().alias("created_at"),
    )
    dup = b.join(first.select("email_key", F.col("seq").alias("_keep")), "email_key").filter(
        F.col("seq") != F.col("_keep")
    )
    rejected = (
        dup.select("email", F.lit("duplicate_in_batch").alias("reason"))
        .unionByName(first.join(existing, "email_key", "left_semi").select("email", F.lit("email_exists").alias("reason")))
        .unionByName(fresh.filter(~ok).select("email", F.lit("income").alias("reason")))
    )
    return users.unionByName(new_users.select(*users.columns)), rejected
