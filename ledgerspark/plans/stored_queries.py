"""Queries over the stored transactions table (ops A3-A7, A5 point reads, F1 deep
pages), each with its DuckDB SQL. Every query ingests the whole raw upload of
the lineitem table into a table of its own in the shared folder and works on that."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import files as IO
from ..sources import ledger as LG
from ..sources import store as ST
from ..sources.adapters import LINEITEM_AS_OF, raw_upload_lineitem, txn_events
from .oracle_sql import EV, _raw_li

OUT = ["id", "user_id", "date", "amount", "category", "merchant"]
#: stored rows: accepted ones, numbered by batch and values
STORED_SQL = f"""{_raw_li()},
stored AS (
  SELECT row_number() OVER (ORDER BY batch_id, date NULLS FIRST, amount NULLS FIRST, category NULLS FIRST, merchant NULLS FIRST,
         CAST(user_id AS VARCHAR) NULLS FIRST) AS id, user_id, date, amount, category, merchant
  FROM vv JOIN b USING (batch_id) WHERE b.ok AND b.n BETWEEN 1 AND 1000)"""
#: the user with the most stored rows
MOST_SQL = "most AS (SELECT user_id, COUNT(*) AS n FROM stored GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1)"


def _stored(spark, d) -> str:
    table = IO.scratch_path(spark, f"ledger-{uuid.uuid4().hex}")
    ST.bulk_ingest(raw_upload_lineitem(spark, d), table, LINEITEM_AS_OF, ingest_id="upload")
    return table


def _most(spark, table):
    return LG.transactions(spark, table).groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()


def a3_stored_table(spark, d):
    """A3, the write: the table after the upload was ingested, and ingested again."""
    table = _stored(spark, d)
    ST.bulk_ingest(raw_upload_lineitem(spark, d), table, LINEITEM_AS_OF, ingest_id="upload")
    return LG.transactions(spark, table).select(*OUT)


def a3_stored_rejects(spark, d):
    """A3: rejected rows by reason."""
    return LG.rejected_rows(spark, _stored(spark, d)).groupBy("batch_id", "reason").agg(F.count(F.lit(1)).alias("rows"))


def a4_append_one(spark, d):
    """A4: one more row for the user with the most rows, sent twice under one request id;
    all rows of that user."""
    table = _stored(spark, d)
    user = _most(spark, table)["user_id"]
    record = {"date": "2001-06-29", "amount": "12.34", "category": "Food", "merchant": "Corner Shop"}
    for _ in range(2):
        ST.append_one(spark, user, record, table, LINEITEM_AS_OF, "request")
    return LG.transactions(spark, table, user_id=user).select(*OUT)


def a5_scan_user_frame(spark, d):
    """A5 as a point read of the stored table."""
    table = _stored(spark, d)
    return LG.scan_user(spark, table, _most(spark, table)["user_id"])


def a6_stored_replace(spark, d):
    """A6 on the stored table: the users of the events table get their events rows."""
    table = _stored(spark, d)
    LG.replace_users(spark, table, txn_events(spark, d).txn.drop("id"))
    return LG.transactions(spark, table).select("user_id", "date", "amount", "category", "merchant")


def a7_stored_purge(spark, d):
    """A7 on the stored table: users of the BUILDING segment go; the other rows keep their ids."""
    table = _stored(spark, d)
    customer = spark.read.parquet(f"{d.rstrip('/')}/customer.parquet")
    LG.purge(spark, table, customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id")))
    return LG.transactions(spark, table).select(*OUT)


def f1_deep_page(spark, d):
    """F1 from the middle of the rows of the user with the most: only the page's months are read."""
    table = _stored(spark, d)
    most = _most(spark, table)
    return LG.user_page(spark, table, most["user_id"], most["count"] // 2, 20).select(*OUT)


def stored_queries() -> dict:
    fns = [a3_stored_table, a3_stored_rejects, a4_append_one, a5_scan_user_frame, a6_stored_replace, a7_stored_purge, f1_deep_page]
    return {f.__name__: f for f in fns}


def stored_sql() -> dict[str, str]:
    out = ", ".join(OUT)
    most = f"WITH {STORED_SQL}, {MOST_SQL}"
    ev = EV.replace("txn AS", "new AS", 1).rsplit("users AS", 1)[0].rstrip().rstrip(",")
    return {
        "a3_stored_table": f"WITH {STORED_SQL} SELECT {out} FROM stored",
        "a3_stored_rejects": f"""WITH {_raw_li()}
SELECT vv.batch_id, CASE WHEN b.n > 1000 THEN 'batch_too_large' WHEN NOT vv.valid THEN 'invalid_row' ELSE 'batch_has_invalid_row' END AS reason,
  COUNT(*) AS rows FROM vv JOIN b USING (batch_id) WHERE NOT (b.ok AND b.n BETWEEN 1 AND 1000) GROUP BY 1, 2""",
        "a4_append_one": f"""{most}
SELECT {out} FROM stored WHERE user_id = (SELECT user_id FROM most)
UNION ALL SELECT (SELECT COUNT(*) + 1 FROM stored), (SELECT user_id FROM most), DATE '2001-06-29', 12.34::DOUBLE, 'Food', 'Corner Shop'""",
        "a5_scan_user_frame": f"""{most}
SELECT user_id, id, date, amount, category, CASE WHEN merchant IS NULL OR merchant = '' THEN 'Unknown' ELSE merchant END AS merchant,
  '' AS description FROM stored WHERE user_id = (SELECT user_id FROM most)""",
        "a6_stored_replace": f"""WITH {STORED_SQL}, {ev}
SELECT user_id, date, amount, category, merchant FROM stored WHERE user_id NOT IN (SELECT user_id FROM new)
UNION ALL SELECT user_id, date, amount, category, merchant FROM new""",
        "a7_stored_purge": f"""WITH {STORED_SQL}
SELECT {out} FROM stored WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
        "f1_deep_page": f"""{most}
SELECT {out} FROM stored WHERE user_id = (SELECT user_id FROM most) ORDER BY date DESC, id DESC LIMIT 20 OFFSET (SELECT n // 2 FROM most)""",
    }
