"""The package's queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillmark.llm import catalog


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    sql = catalog.SQL.get(name)
    if sql is None:
        assert len(got)
        return
    expected = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)
