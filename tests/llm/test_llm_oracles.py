"""The queries that SQL can express against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from entityfusion.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    mine = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    assert mine == sorted(repr([r[want.columns.index(c)] for c in sorted(df.columns)]) for r in want.fetchall())
