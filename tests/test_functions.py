"""Meshes, synthetic catalogues and dates against what they must be."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lithoscope.functions import fragility, geo, hazard, site, time
from lithoscope.operators import catalogue, mesh
from lithoscope.operators import hazard as hz


def test_meshes(spark):
    globe = mesh.fibonacci_global(spark, 500.0)
    assert globe.count() == round(4 * 3.141592653589793 * 6371.0088**2 / 500**2) and globe.where("abs(lat) > 90 or lon < -180 or lon >= 180").isEmpty()
    cap = mesh.fibonacci_cap(spark, 13.0, 46.0, 100.0, 10.0)
    far = cap.select(F.max(geo.great_circle(F.col("lon"), F.col("lat"), F.lit(13.0), F.lit(46.0)))).first()[0]
    assert 90_000 < far <= 100_001 and abs(cap.count() - 314) <= 2
    assert mesh.cartesian(spark, (0.0, 1.0), (2.0, 3.0), 0.1, 0.5).count() == 33
    ring = F.array(F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.05, 1.9), (0.35, 1.9), (0.35, 3.1), (0.05, 3.1)))))
    assert mesh.clipped(mesh.cartesian(spark, (0.0, 1.0), (2.0, 3.0), 0.1, 0.5), ring).count() == 9
    assert mesh.sinusoidal(spark, 1000.0).where("abs(lat) > 90").isEmpty()


def test_round_trips(spark):
    row = spark.range(1).select(F.lit(13.3).alias("lon"), F.lit(-46.2).alias("lat"), F.lit(1234.0).alias("h"))
    for there, back in ((geo.ecef, geo.from_ecef), (geo.on_sphere, geo.from_sphere)):
        got = row.select(*back(*there(F.col("lon"), F.col("lat"), F.col("h")))).first()
        assert got[0] == pytest.approx(13.3) and got[1] == pytest.approx(-46.2, abs=1e-8) and got[2] == pytest.approx(1234.0, abs=1e-3)
    x, y = geo.sinusoidal(F.col("lon"), F.col("lat"))
    assert row.select(*geo.from_sinusoidal(x, y)).first()[0] == pytest.approx(13.3)
    assert row.select(hazard.moment_to_magnitude(hazard.magnitude_to_moment(F.lit(6.1)))).first()[0] == pytest.approx(6.1)
    assert row.select(hazard.magnitude_to_area(hazard.area_to_magnitude(F.lit(100.0), F.lit("normal")), F.lit("normal"))).first()[0] == pytest.approx(100, rel=0.6)


def test_published_values(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(fragility.norm_cdf(F.lit(1.959963984540054))) == pytest.approx(0.975, abs=1e-14)
    assert one(fragility.norm_cdf(F.lit(-8.0))) == pytest.approx(6.22096057427178e-16, rel=1e-8)
    assert one(geo.great_circle(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0))) == pytest.approx(6371008.8 * 3.141592653589793 / 2)
    assert one(geo.dms_to_degrees(F.lit("12 30 36 S"))) == pytest.approx(-12.51)

    def layers(*rows):
        return F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("hl", "vs", "dn", "qs"), r))) for r in rows))

    three = layers((10, 100, 1900, 10), (50, 500, 2000, 20), (0, 1000, 2100, 100))
    for f, depth in ((0.1, 2360), (0.5, 360), (1, 110), (10, 2.5), (100, 0.25)):
        assert one(site.quarter_wavelength_depth(three, F.lit(float(f)))) == pytest.approx(depth)
    assert one(site.site_kappa(three, F.lit(100.0))) == pytest.approx(0.01539, abs=1e-3)
    assert one(site.impedance_amplification(F.lit(200.0), F.lit(1900.0), F.lit(1500.0), F.lit(2500.0))) == pytest.approx(3.14, abs=0.01)
    assert one(site.impedance_amplification(F.lit(200.0), F.lit(1900.0), F.lit(1500.0), F.lit(2500.0), 45.0)) == pytest.approx(2.65, abs=0.01)
    assert one(site.depth_average(layers((10, 5, 0, 0), (20, 10, 0, 0), (5, 50, 0, 0)), lambda x: x["vs"], F.lit(30.0))) == pytest.approx(8.3333, abs=1e-3)


def test_catalogues(spark):
    found = hz.weichert(hz.synthetic_catalogue(spark, 4.0, 1.0, 3.0, 7.0, 2000.0, seed=3).select((F.floor(F.col("m") * 10) / 10 + 0.05).alias("m")).groupBy("m").agg(F.count("*").alias("n")).withColumn("years", F.lit(2000.0)))
    assert found["b"] == pytest.approx(1.0, abs=0.03) and found["rate"] == pytest.approx(10, rel=0.05)
    mags = "array<struct<idx:int,size:double,prime:boolean>>"
    cat = spark.sql(f"select * from values ('a', 1L, cast(array(named_struct('idx',1,'size',3.0D,'prime',true), named_struct('idx',2,'size',3.5D,'prime',false)) as {mags})), ('b', 2L, cast(array() as {mags})) t(event_id, seq, magnitudes)")
    assert [r.event_id for r in catalogue.sort_by(cat, "size").collect()] == ["b", "a"]
    assert [r.event_id for r in catalogue.sort_by(cat, "size", reverse=True).collect()] == ["a", "b"]
    more = catalogue.add_solution(cat, "a", F.struct(F.lit(3).alias("idx"), F.lit(4.0).alias("size"), F.lit(True).alias("prime")))
    assert catalogue.values(more, "size").first().value == 4.0
    assert [m.prime for m in catalogue.get_event(more, "a").first().magnitudes] == [False, False, True]
    assert catalogue.remove(cat, "a").count() == 1


def test_dates(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(time.parse_iso(F.lit("2020-061T01:02:03Z"))) == datetime(2020, 3, 1, 1, 2, 3)
    assert one(time.parse_iso(F.lit("2020-03-01T01:02:03+02:00"))) == datetime(2020, 2, 29, 23, 2, 3)
    assert one(time.from_parts(F.lit(1976), F.lit(5), F.lit(6), F.lit(20), F.lit(0), F.lit(12.5))) == datetime(1976, 5, 6, 20, 0, 12, 500000)
    assert str(one(time.from_ordinal(F.lit(2020), F.lit(60)))) == "2020-02-29"
