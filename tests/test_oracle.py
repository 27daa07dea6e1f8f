"""Each query with SQL against DuckDB over the smallest tables, and every other one for its rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievelake.plans import queries as plans

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else x
        if isinstance(x, bool) or x is None:
            return x
        return float(x) if isinstance(x, int) else str(x)

    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(plans.SQL[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1] or name in ("boilerplate_blocks", "section_boilerplate", "missing_vectors")


@pytest.mark.parametrize("name", sorted(set(plans.Q) - set(plans.SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DIR).collect() is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
