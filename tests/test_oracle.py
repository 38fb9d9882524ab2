"""Every query with SQL gives the same rows as DuckDB; every other query runs."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return None if math.isnan(v) else round(float(v), 5)
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


CORE = {k: f for m in entry.MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in entry.MODULES for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, data, name):
    df = CORE[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name in SQL:
        r = duck.sql(SQL[name])
        assert sorted(r.columns) == columns
        want = sorted(str([plain(dict(zip(r.columns, x))[c]) for c in columns]) for x in r.fetchall())
        assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
