"""Queries take every row of their tables, against SQL or sums without a cut."""

import glob
import math
import os

import duckdb
import pytest

from lithoscope.plans import oracle, queries, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_event_meets_the_sites(spark, db):
    whole = oracle.oracle_sql()["gm_events_near_sites"]
    want = {site: (events, pga) for site, events, pga in db.execute(whole).fetchall()}
    got = {r.site_id: (r.events, r.pga) for r in queries.queries()["gm_events_near_sites"](spark, SF).collect()}
    assert got.keys() == want.keys() and sum(n for n, _ in got.values()) > 1500
    assert all(got[k][0] == n and math.isclose(got[k][1], pga, rel_tol=1e-9, abs_tol=2e-9) for k, (n, pga) in want.items())


def test_every_part_is_a_layer(spark, db):
    whole = oracle.oracle_sql()["site_parameters"]
    cursor = db.execute(whole)
    want = {row[0]: dict(zip((c[0] for c in cursor.description), row)) for row in cursor.fetchall()}
    got = {row["site"]: row.asDict() for row in queries.queries()["site_parameters"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 25
    for site, row in want.items():
        assert all(math.isclose(got[site][c], v, rel_tol=1e-9, abs_tol=2e-6) if isinstance(v, float) else got[site][c] == v for c, v in row.items())
    layers = {row["site"]: len(row["layers"]) for row in views.profiles(spark, SF).collect()}
    assert sum(layers.values()) == db.execute("SELECT count(*) FROM part").fetchone()[0] and 1 in layers.values()
    transfer = {row.sid: row.amplitude for row in queries.queries()["site_sh_transfer"](spark, SF).collect()}
    assert transfer.keys() == layers.keys()
    assert all(transfer[s] == [1.0, 1.0, 1.0] for s, n in layers.items() if n == 1)
