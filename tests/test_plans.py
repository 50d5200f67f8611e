"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = {k: v for p in __spark_entry__.PLANS for k, v in p.items()}
SQL = {k: v for p in __spark_entry__.PLANS for k, v in p.sql.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return plain(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = PLANS[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    wanted = sorted((tuple(plain(v) for v in r) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == wanted


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
