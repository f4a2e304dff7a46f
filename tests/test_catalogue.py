"""Every catalogue query against its SQL on the smallest tables, and the entry point's contract."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = sql.execute(catalogue.SQL[name])
    named = [d[0] for d in want.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    expected = Counter(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert Counter(repr(tuple(map(plain, r))) for r in df.select(columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
