"""Every SQL-checked query against its DuckDB statement on the smallest
driver tables: same columns, same rows, same values (exact)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if type(v).__name__ == "date":
        return v.isoformat()
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, repr(v)) for v in row)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


SQL = E.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    got = [tuple(_norm(v) for v in r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = [cols.index(c) for c in df.columns]
    exp = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(got, key=_key) == sorted(exp, key=_key)
    rel = duck.sql(SQL[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert spark_types == duck_types


def test_every_sql_key_is_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["user_id", "month"]
    assert df.count() >= 0
