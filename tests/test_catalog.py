"""Every catalogue query with a SQL twin gives the same rows."""

import importlib.util
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check", pathlib.Path(__file__).parent.parent / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([check.norm(v) for v in r]) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    assert got == sorted(repr([check.norm(r[i]) for i in order]) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
