"""Every query with SQL against DuckDB on the smallest tables, rows and column names alike."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

_LLM = tuple(f"p{n}_" for n in (1, 2, 3, 5, 6, 7, 8))
CORE = [q for q in entry.queries() if not q.startswith(_LLM)]


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


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, small, name):
    got = entry.queries()[name](spark, small).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    expected = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_llm_package():
    top = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(top, "quillmark")):
        if "llm" in folder.split(os.sep):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "quillmark.llm" not in open(os.path.join(folder, f)).read(), f
