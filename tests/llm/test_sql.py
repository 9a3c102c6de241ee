"""Queries that have SQL give what DuckDB gives, over whole tables, under equal column names."""

import glob
import os

import duckdb
import pytest

from pagedrift.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    got = found.select(*columns).toPandas().itertuples(index=False, name=None)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    want = want.select(", ".join(columns)).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
