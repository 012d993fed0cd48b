"""Each query with SQL against DuckDB over the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return order, sorted((tuple(clean(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.sql(entry.oracle_sql()[name])
    names, a = rows(df.columns, [tuple(r) for r in df.collect()])
    other, b = rows(got.columns, got.fetchall())
    assert names == other and len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, abs_tol=2e-6)), (name, x, y)


def test_chunked_averages_round_as_sql_does(spark):
    """Over series of more than one chunk; one slope here is -0.09760249999977."""
    name, sf = "chunked_emas", SF.replace("0.001", "0.01")
    df = entry.queries()[name](spark, sf)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
        got = con.sql(entry.oracle_sql()[name])
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(got.columns, got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
