"""Every registered query with SQL equals DuckDB on the smallest tables; the others have rows."""

import glob
import os

import duckdb
import pytest

from phredloom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    sql = catalog.oracle_sql().get(name)
    if sql:
        got = duck.execute(sql)
        cols = [d[0] for d in got.description]
        assert sorted(cols) == sorted(df.columns)
        at = [cols.index(c) for c in df.columns]
        want = [tuple(r[i] for i in at) for r in got.fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.queries()) <= set(e.queries())
