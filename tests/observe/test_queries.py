"""Every query with SQL gives what DuckDB gives; the others run."""

import glob
import os

import duckdb
import pytest

from pagedrift.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in SQL:
        want = duck.sql(SQL[name])
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
