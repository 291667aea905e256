import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.functions import geo
from lithoscope.operators import hazard, records
from lithoscope.sources import catalogues, models, waveforms, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_catalogue_round_trip(spark, tmp_path):
    mags = spark.createDataFrame([("e1", 0, 5.0, "ML"), ("e1", 1, 5.2, "MW"), ("e2", 0, 3.0, None)], "event_id string, idx int, size double, type string")
    locs = spark.createDataFrame([("e1", 0, 13.0, 42.0), ("e3", 0, 1.0, 2.0)], "event_id string, idx int, lon double, lat double")
    writers.write_catalogue(mags, locs, str(tmp_path / "c"))
    got_mags, got_locs = catalogues.read_json(spark, str(tmp_path / "c"), lines=True)
    assert rows(got_mags.select(mags.columns)) == rows(mags)
    assert rows(got_locs.select(locs.columns)) == rows(locs)


def test_models_round_trip(spark, tmp_path):
    assets = spark.createDataFrame([("a", 13.0, 42.0, 0.0, True, 600.0), ("b", 14.0, 43.0, 5.0, False, None)], "asset_id string, lon double, lat double, elevation double, aggregated boolean, vs30 double")
    kinds = spark.createDataFrame([("a", "RC", 3.0), ("a", "MU", 2.0)], "asset_id string, taxonomy string, n double")
    writers.write_exposure(assets, kinds, str(tmp_path / "x"))
    got, got_kinds = models.read_exposure(spark, str(tmp_path / "x"), lines=True)
    assert rows(got.select(assets.columns)) == rows(assets) and rows(got_kinds.select(kinds.columns)) == rows(kinds)

    points = "points array<struct<im:double,poe:double>>"
    levels = spark.createDataFrame(
        [("m", "PGA", "lognormal", 2, "D2", 0.4, 0.5, None, None), ("m", "PGA", "lognormal", 1, "D1", 0.2, 0.5, None, None), ("t", "PGA", "table", 1, "D1", None, None, [(0.1, 0.0), (0.2, 1.0)], True)],
        f"model_id string, imt string, model_type string, level_ord int, level string, theta double, beta double, {points}, log_im boolean",
    )
    writers.write_fragility(levels, str(tmp_path / "f"))
    assert rows(models.read_fragility(spark, str(tmp_path / "f"), lines=True).select(levels.columns)) == rows(levels)

    refs = spark.createDataFrame([("RC", "m", 0.5), ("RC", "t", 0.5), ("MU", "m", 1.0)], "taxonomy string, model_id string, weight double")
    writers.write_taxonomy(refs, str(tmp_path / "t"))
    assert rows(models.read_taxonomy(spark, str(tmp_path / "t"), lines=True)) == rows(refs)
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_taxonomy(refs, str(tmp_path / "t"))


def test_geojson_round_trip(spark, tmp_path):
    shapes = spark.createDataFrame(
        [('a"q', "Polygon", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]), ("p", "Point", [[(3.0, 4.0)]]), ("m", "MultiPolygon", [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0)]]), ("n", "MultiPoint", [[(1.0, 2.0), (3.0, 4.0)]]), ("none", "Polygon", [])],
        "id string, kind string, parts array<array<struct<lon:double,lat:double>>>",
    )
    writers.write_geojson(shapes, str(tmp_path / "g"))
    got = {r.id: [[tuple(p) for p in ring] for ring in r.parts or []] for r in models.read_geojson(spark, str(tmp_path / "g"), lines=True).collect()}
    assert got.pop("none") == [] and '"geometry":null' in "".join(x.value for x in spark.read.text(str(tmp_path / "g")).collect())
    with pytest.raises(Exception, match="no geometry of kind LineString"):
        writers.write_geojson(shapes.withColumn("kind", F.lit("LineString")), str(tmp_path / "bad"))
    assert got == {'a"q': [[(0, 0), (1, 0), (1, 1), (0, 0)]], "p": [[(3, 4)]], "m": [[(0, 0), (1, 0), (0, 0)], [(5, 5), (6, 5), (5, 5)]], "n": [[(1, 2), (3, 4)]]}


def test_records_responses_and_tables(spark, tmp_path):
    made = spark.createDataFrame([("IT.ABC.00.HNE", "20120520_020303.000", 0.005, [1.5, -2.0, 0.25]), ("IT.ABC..HNN", "20120520_020303.000", 0.005, [1.0])], "sid string, t0 string, delta double, data array<double>")
    writers.write_dyna(made, str(tmp_path / "d"))
    assert rows(waveforms.read_dyna(spark, str(tmp_path / "d"))) == rows(made)
    stages = spark.createDataFrame([("X", datetime(2020, 1, 1), None, 1, 2.0, 1.0, [(-1.0, 2.0)], [])], writers.RESPONSE)
    writers.write_responses(stages, str(tmp_path / "r"))
    assert rows(writers.read_responses(spark, str(tmp_path / "r"))) == rows(stages)
    table = spark.createDataFrame([(4.0, 1900, None), (5.0, 1800, 0.9)], "magnitude double, year_start int, completeness double")
    writers.write_table(table, str(tmp_path / "t"))
    assert rows(catalogues.read_table(spark, str(tmp_path / "t"), {"magnitude": "double", "year_start": "int", "completeness": "double"})) == rows(table)
    writers.write_sorted(table, ["year_start"], str(tmp_path / "s"))
    lines = [line for f in sorted((tmp_path / "s").glob("part-*")) for line in f.read_text().splitlines()]
    assert [json.loads(line)["year_start"] for line in lines] == [1800, 1900]


def test_nrml_exposure(spark, tmp_path):
    (tmp_path / "e.xml").write_text(
        '<nrml><exposureModel id="e"><assets><asset id="a1" number="3" taxonomy="RC"><location lon="13.5" lat="42"/><costs><cost type="structural" value="1"/><cost type="structural" value="2"/></costs>'
        '<occupancies><occupancy occupants="4" period="day"/><occupancy occupants="6" period="night"/></occupancies></asset><asset id="a2" number="1" taxonomy="MU"><location lon="14" lat="43"/></asset></assets></exposureModel></nrml>'
    )
    got = {r.asset_id: r for r in writers.read_nrml_exposure(spark, str(tmp_path / "e.xml")).collect()}
    assert tuple(got["a1"])[1:5] == (13.5, 42.0, "RC", 3.0) and got["a1"].costs == {"structural": 2.0} and got["a1"].occupants == {"day": 4.0, "night": 6.0}
    assert got["a2"].costs is None and got["a2"].number == 1.0


def test_rows_are_numbered_across_files_and_partitions(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for k in range(3):
        (tmp_path / "c" / f"{k}.csv").write_text("Year,MagSize\n" + "".join(f"{1900 + k},{i}\n" for i in range(4)))
    got = catalogues.read_csv(spark, str(tmp_path / "c")).collect()
    assert sorted(int(r.event_id) for r in got) == list(range(12))
    for year in range(1900, 1903):  # rows of a file follow one another
        ids = [int(r.event_id) for r in sorted(got, key=lambda r: r["size"]) if r.ts.year == year]
        assert ids == list(range(ids[0], ids[0] + 4))


def test_rates_of_few_events(spark):
    none = spark.createDataFrame([], "m double, n long, years double")
    assert hazard.weichert(none) == {"b": None, "b_sigma": None, "rate": None, "a": None}
    one = spark.createDataFrame([(4.0, 6, 30.0)], "m double, n long, years double")
    assert hazard.weichert(one) == {"b": None, "b_sigma": None, "rate": 0.2, "a": None}


def test_padding_convolution_and_correlation():
    rng = np.random.default_rng(1)
    for n, m in ((50, 7), (7, 50), (8, 8), (5, 4)):
        x, y = rng.normal(size=n), rng.normal(size=m)
        full = np.convolve(x, y)
        assert np.allclose(records.convolved(x, y), full)
        assert np.allclose(records.convolved(x, y, "same"), full[(m - 1) // 2 :][:n])
        assert np.allclose(records.convolved(x, y, "valid"), np.convolve(x, y, "valid"))
        assert np.allclose(records.correlated(x, y), np.correlate(x, y, "full"))
    assert records.correlated(np.roll(np.eye(1, 64)[0], 9), np.eye(1, 64)[0]).argmax() - 63 == 9
    assert len(records.convolved(np.zeros(0), np.ones(3))) == 0
    assert len(records.zero_padded(np.ones(5), 0.5)) == 10 and len(records.zero_padded(np.ones(5), 0.1, 0.3)) == 8
    with pytest.raises(ValueError):
        records.zero_padded(np.ones(5), 0.1, 0.25)
    x = rng.normal(size=33)
    assert np.allclose(records.from_spectrum(records.spectrum(x, 0.01)[1], 0.01, 33), x)


def test_instruments_and_oscillators():
    rng = np.random.default_rng(2)
    x = rng.normal(size=256)
    poles, zeros = np.array([-5 + 2j, -5 - 2j]), np.array([])
    assert np.abs(records.deconvolved(records.convolved_response(x, 0.01, 29.0, poles, zeros), 0.01, 29.0, poles, zeros) - x)[:200].max() < 0.05
    assert np.allclose(records.fir_transfer(np.array([1.0, 1.0]), np.array([1.0]), 3), [2, 1 - 1j, 0])
    assert abs(records.oscillator_transfer(np.array([0.0]), 2.0)[0] - 0.25) < 1e-12
    t = np.arange(400) * 0.01
    assert np.allclose(np.diff(records.instantaneous_phase(np.cos(2 * np.pi * 5 * t)))[50:-50], 2 * np.pi * 5 * 0.01, atol=1e-3)


def test_frames_and_boxes(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (2.0, 0.0), (1.0, 3.0))))
    place = tuple(map(F.lit, (13.4, 42.3, 700.0)))
    origin = tuple(map(F.lit, (13.0, 42.0, 100.0)))
    back = geo.from_enu(*geo.enu(*place, *origin), *origin)
    got = spark.range(1).select(*back, *geo.bounding_box(ring), *geo.mean_point(ring)).first()
    assert np.allclose(got, [13.4, 42.3, 700.0, 0, 0, 2, 3, 1, 1], atol=1e-6)
