"""Every query against its SQL in another engine, row by row."""

import glob
import math
import os

import duckdb
import pytest

from lithoscope.plans import oracle, queries

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
        return
    names = sorted(df.columns)
    cursor = db.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    want = sorted((tuple(row[columns.index(n)] for n in names) for row in cursor.fetchall()), key=str)
    got = sorted((tuple(row[n] for n in names) for row in df.collect()), key=str)
    assert len(got) == len(want) > 0
    wrong = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not wrong, wrong[:3]
