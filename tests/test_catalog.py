"""Registered engine queries against their SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from quadrille import catalog, catalog_more, catalog_rules

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"owl_same_as", "datalog_conversation_chain"}
CASES = {**catalog.queries(), **catalog_rules.queries(), **catalog_more.queries()}
SQL = {**catalog.oracle_sql(), **catalog_rules.oracle_sql(), **catalog_more.oracle_sql()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def norm(v):
    if v is None or v != v:
        return "null"
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", [n for n in CASES if n not in SLOW])
def test_query_matches_sql(spark, duck, name):
    df, want = CASES[name](spark, DIR), duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(norm(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
