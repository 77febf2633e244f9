"""Every catalogue query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.plans import catalogue, streams  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DIR}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.ORACLE_SQL) <= set(entry.queries())
