"""Every registered query against its SQL at the smallest size."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(n for n in SQL if not n.startswith("op") and n != "pipeline")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert names == sorted(want.columns)
    place = [want.columns.index(n) for n in names]
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3
