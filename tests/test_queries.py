"""Every query that has SQL for the same rows, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lociforge.jobs.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _comparable(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert _comparable(got) == _comparable(tuple(r[i] for i in places) for r in found.fetchall())


def test_queries_without_sql_have_rows(spark, duck):
    for name in QUERIES.keys() - ORACLE_SQL.keys():
        assert QUERIES[name](spark, DATA).count() > 0
