"""Every registered query of the mobility operators against its SQL, on the same tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

from roadlens import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_what_sql_gives(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_documents_are_made(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
