"""The queries against their SQL in another engine, row by row."""

import glob
import os

import duckdb
import pytest

from lithoscope.llm import oracle, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want
