"""Every registered query runs, and those with SQL give the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from skyaccord import catalogue
from tests.conftest import SF

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    rows = got.collect()
    text = catalogue.oracle_sql().get(name)
    assert rows
    if text:
        cursor = con.execute(text)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(got.columns)
        want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
        mine = sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)
        assert len(mine) == len(want)
        for a, b in zip(mine, want):
            assert all(x == y or (isinstance(x, float) and y is not None and abs(x - y) <= 2e-4 * max(1, abs(y))) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
