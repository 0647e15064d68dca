"""Every query with SQL against DuckDB on the smallest tables, and the others' rows."""

import glob
import os

import duckdb
import pytest

from barloom.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
SLOW = {"ml_tree_suite", "ml_walkforward"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-5 * max(1, abs(a))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_against_sql(spark, duck, name):
    df = all_queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*cols).collect()]
    rel = duck.execute(all_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    order = lambda r: tuple((x is None, "" if isinstance(x, float) else str(x)) for x in r) + tuple((x is None, x or 0.0) for x in r if isinstance(x, (float, type(None))))
    assert len(got) == len(want)
    assert all(close(a, b) for a, b in zip(sorted(got, key=order), sorted(want, key=order)))


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql()) - SLOW))
def test_without_sql(spark, name):
    assert all_queries()[name](spark, SF).count() > 0
