"""Every query against its DuckDB twin on the smallest data; queries without a twin must run and give rows."""

import os

import duckdb
import pytest

from grainsift.plans import registry
from grainsift.session import TABLES

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


def rows_of(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert got == rows_of(want.fetchall(), want.columns)
    else:
        assert got[1]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries().keys()
    assert entry.oracle_sql().keys() <= names
    assert set(QUERIES) <= set(names)
