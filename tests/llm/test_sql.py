"""Every registered query that SQL can tell, against that SQL on the same tables."""

import duckdb
import pytest

from roadlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=repr)
