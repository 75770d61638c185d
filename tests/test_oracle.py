"""Every registered query against its SQL in DuckDB, on the smallest data set."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from depgraph_spark.catalog import all_queries
from depgraph_spark.oracle import all_sql

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = all_queries()
SQL = all_sql()


def plain(value):
    if isinstance(value, float):
        return round(value, 8)
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(plain(row[i]) for i in order) for row in found.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_entry_has_every_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
