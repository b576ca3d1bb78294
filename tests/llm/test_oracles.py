"""Queries of the subpackage against their SQL, on whole tables."""

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*order).collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
