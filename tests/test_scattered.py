import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import impact, scattered
from lithoscope.sources import shakemap, writers

GRID = """<?xml version="1.0"?>
<shakemap_grid xmlns="http://earthquake.usgs.gov/eqcenter/shakemap" event_id="x"
  code_version="4.0">
<event magnitude="6.1" lat="42.5" lon="13.5"/>
{fields}
<grid_data>
{data}
</grid_data>
</shakemap_grid>
"""


def brute(px, py, xs, ys):
    """Nodes and weights of the triangle of least mean squared distance around a place, among all triples."""
    best, found = np.inf, None
    for t in itertools.combinations(range(len(xs)), 3):
        x, y = xs[list(t)] - px, ys[list(t)] - py
        m = np.array([x, y, [1, 1, 1]])
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        w = np.linalg.solve(m, [0, 0, 1])
        q = (w * (x * x + y * y + scattered.SHEAR * x * y)).sum()
        if (w > -1e-10).all() and q < best - 1e-15:
            best, found = q, (list(t), w)
    return found


def expected(px, py, xs, ys, z):
    found = brute(px, py, xs, ys)
    return None if found is None else sum(z[k] * w for k, w in zip(*found) if w > 1e-10)


def circle_is_empty(nodes, t):
    """Direct test of Delaunay's property: no node lies in the circle through three."""
    a, b, c = (nodes[k] for k in t)
    m = 2 * np.array([b - a, c - a])
    centre = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
    r = np.hypot(*(a - centre))
    return all(np.hypot(*(n - centre)) > r - 1e-6 for n in nodes)


def test_triangles_are_delaunay():
    rng = np.random.default_rng(2)
    nodes, sites = rng.uniform(0, 10, (400, 2)), rng.uniform(1, 9, (300, 2))
    corners, weights, circle = scattered.triangles(sites[:, 0], sites[:, 1], nodes[:, 0], nodes[:, 1])
    assert (corners < 400).all() and (weights > -1e-9).all()
    assert np.allclose((nodes[corners] * weights[:, :, None]).sum(1), sites)
    assert all(circle_is_empty(nodes, t) for t in corners)
    assert np.allclose(np.hypot(*(nodes[corners[:, 0]] - circle[:, :2]).T), circle[:, 2], rtol=1e-5)


@pytest.mark.parametrize("kind", ["scattered", "regular", "clustered", "line", "none"])
def test_values_are_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    nodes = rng.uniform(0, 6, (24, 2))
    if kind == "regular":
        nodes = np.array([(x, y) for x in range(5) for y in range(5)], float)
    if kind == "clustered":  # far from each other, so that sites between them need wide cells
        nodes = np.concatenate([rng.normal(c, 0.01, (6, 2)) for c in ((0, 0), (6, 0), (0, 6), (6, 6))])
    if kind == "line":
        nodes = np.array([(x, 2 * x) for x in range(5)], float)
    z = rng.uniform(size=len(nodes))
    sites = np.concatenate([rng.uniform(-1, 7, (60, 2)), nodes[:5], (nodes[:4] + nodes[1:5]) / 2])
    made = spark.createDataFrame([(float(x), float(y), float(v), None if k == 3 else 1.0) for k, ((x, y), v) in enumerate(zip(nodes, z))] + [(None, 1.0, 9.0, 9.0)], "lon double, lat double, v double, `w.x` double")
    if kind == "none":
        made = made.limit(0)
    asked = spark.createDataFrame([(k, float(x), float(y), "kept") for k, (x, y) in enumerate(sites)] + [(-1, None, 1.0, "kept"), (0, float(sites[0, 0]), float(sites[0, 1]), "kept")], "id long, lon double, lat double, `a b` string")
    got = scattered.scattered_values(made, asked, ["v", "w.x"])
    assert got.columns == [*asked.columns, "v", "w.x"]
    rows = {r[0]: r for r in got.collect()}
    assert got.count() == len(sites) + 2 and rows[-1].v is None
    for k, (x, y) in enumerate(sites):
        want = None if kind == "none" else expected(x, y, nodes[:, 0], nodes[:, 1], z)
        if kind == "line" and k >= 60:  # on the line itself
            want = np.interp(x, nodes[:, 0], z)
        assert (rows[k].v is None) == (want is None) and (want is None or rows[k].v == pytest.approx(want, abs=1e-7)), (k, rows[k], want)
        if want is not None and kind != "line":
            uses = any(t == 3 and w > 1e-10 for t, w in zip(*brute(x, y, nodes[:, 0], nodes[:, 1])))
            assert (rows[k][5] is None) == uses


def test_maps_are_kept_apart(spark):
    nodes = spark.createDataFrame([(m, float(x), float(y), m + x + 2.0 * y) for m in (0, 10, None) for x in range(9) for y in range(9) for m in [m] if m is not None] + [(None, float(x), float(y), -1.0) for x in range(2) for y in range(2)], "event long, lon double, lat double, v double")
    sites = spark.createDataFrame([(0, 1.25, 3.5), (10, 1.25, 3.5), (None, 0.5, 0.25), (7, 1.0, 1.0)], "event long, lon double, lat double")
    got = scattered.scattered_values(nodes, sites, ["v"], by=["event"])
    assert sorted(map(tuple, got.select("event", "v").collect()), key=str) == sorted([(0, 8.25), (10, 18.25), (None, -1.0), (7, None)], key=str)


def test_sites_meet_nodes_on_cells(spark, monkeypatch):
    plans = []
    real = scattered.staged
    monkeypatch.setattr(scattered, "staged", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label))
    nodes = spark.range(50).select((F.col("id") % 7).cast("double").alias("lon"), (F.col("id") % 11).cast("double").alias("lat"), F.col("id").alias("v"))
    scattered.scattered_values(nodes, nodes.drop("v"), ["v"]).count()
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    # without ``by`` the one row of the map is given to all; everything else meets by equality
    nodes_met = [line for line in joins if "cx" in line]
    assert nodes_met and all(line.count("=") == 3 for line in nodes_met) and all("=" in line or "Join LeftOuter" in line or "Join Inner" in line for line in joins)


def test_shakemap_files(spark, tmp_path):
    names, sd = ("LON", "LAT", "PGA", "MMI"), ("LON", "LAT", "STDPGA")
    nodes = [(13 + x / 10, 42 + y / 10, x + 10.0 * y, "nan" if x == 2 else 5.0, 0.5) for x in range(5) for y in range(4)]
    for n, event in enumerate(("us1", "us2")):
        folder = tmp_path / event
        folder.mkdir()
        fields = "\n".join(f'<grid_field index="{k + 1}" name="{f}" units="x"/>' for k, f in enumerate(names))
        folder.joinpath("grid.xml").write_text(GRID.format(fields=fields, data="\n".join(f"{a} {b} {v + 100 * n} {m}" for a, b, v, m, _ in nodes) + "\n1 2\n"))
        fields = "".join(f'<grid_field index="{k + 1}" name="{f}" units="x"/>' for k, f in enumerate(sd))
        folder.joinpath("uncertainty.xml").write_text(GRID.format(fields=fields, data="\n".join(f"{a} {b} {s}" for a, b, _, _, s in nodes)))
        folder.joinpath("info.json").write_text('{"input": {"event_information": {"event_id": "%s", "magnitude": "6.1", "longitude": "13.2", "latitude": "42.1", "depth": "8", "origin_time": "2009-04-06"}},\n "output": {"ground_motions": {"PGA": {"units": "%%g"}}}}' % event)
    grid = shakemap.with_uncertainty(shakemap.read_grid(spark, f"{tmp_path}/*/grid.xml"), shakemap.read_grid(spark, f"{tmp_path}/*/uncertainty.xml"))
    got = sorted((r.map_id, r.lon, r.lat, r["values"]["PGA"], r["values"]["MMI"], r["values"]["STDPGA"]) for r in grid.where("values['MMI'] is not null").collect())
    assert got == sorted((e, a, b, v + 100 * n, m, s) for n, e in enumerate(("us1", "us2")) for a, b, v, m, s in nodes if m != "nan") and grid.count() == 40
    info = shakemap.read_info(spark, f"{tmp_path}/*/info.json").orderBy("map_id").collect()
    assert [(r.map_id, r.event_id, r.magnitude, r.depth, r.units) for r in info] == [(e, e, 6.1, 8.0, {"PGA": "%g"}) for e in ("us1", "us2")]

    sites = shakemap.site_columns(spark.createDataFrame([("a", 13.15, 42.05, 1), ("b", 13.35, 42.2, 2), ("c", 20.0, 42.0, 3)], "Site_ID string, longitude double, LAT double, other int"))
    values = shakemap.values_at(grid.where("map_id = 'us2'"), sites, ["PGA", "MMI"], fill=-1.0).orderBy("id")
    assert [(r.id, round(r.PGA, 9), r.MMI) for r in values.collect()] == [("a", 106.5, -1.0), ("b", 123.5, 5.0), ("c", -1.0, -1.0)]
    both = shakemap.values_at(grid, sites.crossJoin(spark.createDataFrame([("us1",), ("us2",)], "map_id string")), ["PGA"], by_map=True)
    assert sorted((r.map_id, r.id, None if r.PGA is None else round(r.PGA, 9)) for r in both.where("id <> 'c'").collect()) == [("us1", "a", 6.5), ("us1", "b", 23.5), ("us2", "a", 106.5), ("us2", "b", 123.5)]
    shakemap.write_values(values, str(tmp_path / "out"))
    back = spark.read.schema("geometry struct<coordinates:array<double>>, properties struct<id:string,PGA:double>").json(str(tmp_path / "out"))
    assert sorted((r.properties.id, r.geometry.coordinates[0]) for r in back.collect()) == [("a", 13.15), ("b", 13.35), ("c", 20.0)]
    writers.write_table(values, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3

    assets = spark.createDataFrame([("a", 13.15, 42.05, 0.0), ("c", 20.0, 42.0, 0.0)], "asset_id string, lon double, lat double, elevation double")
    motion = shakemap.motion(grid.where("map_id = 'us1'"), assets)
    assert sorted((r.asset_id, None if r.median is None else round(r.median, 9), round(r.sigma, 9)) for r in motion.collect()) == [("a", 0.065, 0.5), ("c", None, 0.0)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    damage = impact.typology_damage(motion.where("median is not null"), frame([("a", "t", 2.0)], "asset_id string, taxonomy string, n double"), frame([("t", "m", 1.0)], "taxonomy string, model_id string, weight double"), frame([("m", 1, "D1", 0.065, 0.5)], "model_id string, level_ord int, level string, theta double, beta double"))
    assert [round(p, 9) for p in impact.asset_damage(damage).first().p] == [0.5, 0.5]
