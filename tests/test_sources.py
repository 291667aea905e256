import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from lithoscope.sources import catalogues, models, mseed, waveforms

T0 = datetime(2024, 2, 29, 23, 59, 58, 500000)


@pytest.mark.parametrize("encoding", [1, 3, 4, 5, 10, 11])
def test_mseed_round_trip(spark, tmp_path, encoding):
    rng = np.random.default_rng(encoding)
    values = np.cumsum(rng.integers(-40, 40, 3000)).clip(-30000, 30000)
    values[5:9] = [0, 1000, -1000, 0]
    (tmp_path / "a.ms").write_bytes(mseed.to_bytes("IV.ABC.00.HHZ", T0, 0.01, values, encoding))
    (tmp_path / "b.ms").write_bytes(mseed.to_bytes("IV.XYZ..HHN", T0 + timedelta(seconds=60), 0.01, values[:50], encoding))
    rows = {r.sid: r for r in mseed.merge(mseed.read(spark, str(tmp_path))).collect()}
    assert rows["IV.ABC.00.HHZ"].data == values.astype(float).tolist() and rows["IV.ABC.00.HHZ"].t0 == T0
    assert rows["IV.XYZ..HHN"].delta == pytest.approx(0.01)
    again = mseed.encode(mseed.merge(mseed.read(spark, str(tmp_path / "b.ms")))).first().content
    assert next(mseed.parse_records(bytes(again)))["data"].tolist() == values[:50].tolist()


def test_fibonacci_by_every_encoding():
    values = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233]
    for encoding in (1, 3, 4, 5, 10, 11):
        (record,) = mseed.parse_records(mseed.to_bytes("XX.TEST..BHE", T0, 1.0, np.array(values), encoding))
        assert record["data"].tolist() == values


def test_sac_and_dyna(spark, tmp_path):
    values = np.arange(100) / 8
    (tmp_path / "x.sac").write_bytes(waveforms.build_sac("IV.ABC.00.HHZ", T0, 0.005, values))
    row = waveforms.read_sac(spark, str(tmp_path / "x.sac")).first()
    assert (row.sid, row.t0, row.delta, row.data) == ("IV.ABC.00.HHZ", T0, 0.005, values.tolist())
    head = ["NETWORK: IT", "STATION_CODE: ABC", "LOCATION: 00", "STREAM: HNE", "SAMPLING_INTERVAL_S: 0.005", "DATE_TIME_FIRST_SAMPLE_YYYYMMDD_HHMMSS: 20120520_020303.000"]
    (tmp_path / "x.txt").write_text("\n".join(head + ["X:"] * (64 - len(head)) + ["1.5", "-2", "3e-1", ""]))
    row = waveforms.read_dyna(spark, str(tmp_path / "x.txt")).first()
    assert (row.sid, row.delta, row.data) == ("IT.ABC.00.HNE", 0.005, [1.5, -2.0, 0.3])


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("#note\nYear,Month,Day,Latitude,Longitude,Depth,MagSize,MagType\n2020,3,1,46.1,13.2,nan,4.5,Mw\n1976,None,,46.2,13.1,5,6.4,Ml\n")
    rows = catalogues.read_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.event_id, r.ts.year, r.ts.month, r.depth, r.size) for r in rows] == [("0", 2020, 3, None, 4.5), ("1", 1976, 1, 5.0, 6.4)]
    (tmp_path / "c.json").write_text(json.dumps({"EqDatabase": {"Header": {}, "Event": [{"Id": "a", "Magnitude": [{"size": 3.1}, {"size": 3.2}], "Location": [{"lon": 1.0}]}]}}))
    mags, locs = catalogues.read_json(spark, str(tmp_path / "c.json"))
    assert mags.count() == 2 and locs.first().lon == 1.0
    quake = """<q:quakeml><eventParameters><event publicID="quakeml:x/event/7"><preferredOriginID>o2</preferredOriginID>
      <origin publicID="o1"><time><value>2020-01-01T00:00:00Z</value></time><latitude><value>46</value></latitude><longitude><value>13</value></longitude><depth><value>8000</value></depth></origin>
      <origin publicID="o2"><time><value>2020-01-01T00:00:01Z</value></time><latitude><value>46.5</value></latitude><longitude><value>13</value></longitude></origin>
      <magnitude publicID="m1"><mag><value>4.2</value></mag><type>Mw</type></magnitude></event></eventParameters></q:quakeml>"""
    (tmp_path / "c.xml").write_text(quake)
    mags, locs = catalogues.read_quakeml(spark, str(tmp_path / "c.xml"))
    assert [(r.event_id, r.depth, r.prime) for r in locs.orderBy("idx").collect()] == [("7", 8.0, False), ("7", None, True)] and mags.first().size == 4.2


def test_isf(spark, tmp_path):
    def place(*fields):
        line = ""
        for at, text in fields:
            line = line.ljust(at - 1) + text
        return line

    origin = place((1, "2010/01/02"), (12, "03:04:05.60"), (37, " 46.1000"), (46, "  13.2000"), (72, " 10.0"), (119, "ISC"))
    other = place((1, "2010/01/02"), (12, "03:04:06.00"), (37, " 46.2000"), (46, "  13.3000"), (72, "  5.0"), (119, "NEIC"))
    mag = place((1, "mb"), (7, " 4.5"), (12, "0.2"), (21, "ISC"))
    text = f"BULLETIN\nEvent  123 SOMEWHERE\n\n   Date       Time        Err\n{origin}\n (#PRIME)\n{other}\n\nMagnitude  Err Nsta Author\n{mag}\n\n"
    (tmp_path / "b.isf").write_text(text)
    mags, locs = catalogues.read_isf(spark, str(tmp_path / "b.isf"))
    got = locs.orderBy("idx").collect()
    assert [(r.event_id, r.lat, r.lon, r.depth, r.prime) for r in got] == [("123", 46.1, 13.2, 10.0, True), ("123", 46.2, 13.3, 5.0, False)]
    assert [(r.type, r["size"], r.error) for r in mags.collect()] == [("mb", 4.5, 0.2)]


def test_models_and_issues(spark, tmp_path):
    asset = lambda i, lon, kinds: {"id": i, "aggregated": False, "reference_location": {"longitude": lon, "latitude": 46.0}, "typologies": kinds}
    (tmp_path / "e.json").write_text(json.dumps({"assets": [asset("1", 13.0, [{"taxonomy": "M", "count": 3}]), asset("2", 200.0, [{"taxonomy": "M", "count": 0}, {"taxonomy": "", "count": 1}])]}))
    assets, kinds = models.read_exposure(spark, str(tmp_path / "e.json"))
    assert assets.count() == 2 and kinds.count() == 3
    assert {r.message for r in models.exposure_issues(assets, kinds).collect()} == {"longitude out of range", "count is not positive", "taxonomy is blank", "single asset with several typologies"}
    scale = {"id": "s", "levels": ["D1", "D2"]}
    frag = [{"id": "L", "imt": "PGA", "model_type": "lognormal", "damage_scale": scale, "parameters": {"D1": {"theta": 0.1, "beta": 0.5}, "D2": {"theta": -1, "beta": 0.5}}},
            {"id": "T", "imt": "PGA", "model_type": "discrete", "damage_scale": scale, "tables": {k: {"im": [0.1, 0.2], "poe": p} for k, p in (("D1", [0, 1]), ("D2", [1, 0]))}}]
    (tmp_path / "f.json").write_text(json.dumps({"models": frag}))
    levels = models.read_fragility(spark, str(tmp_path / "f.json"))
    assert {(r.path, r.message) for r in models.fragility_issues(levels).collect()} == {("models/L/D2", "theta and beta must be positive"), ("models/T/D2", "table must rise")}
    (tmp_path / "t.json").write_text(json.dumps({"mappings": {"M": {"fragility_models": [{"id": "L"}, {"id": "X", "weight": 0.5}]}}}))
    refs = models.read_taxonomy(spark, str(tmp_path / "t.json"))
    assert {(r.model_id, r.weight) for r in refs.collect()} == {("L", 1.0), ("X", 0.5)} and models.taxonomy_issues(refs, levels).first().message == "model is unknown"
    ring = [[12, 45], [14, 45], [14, 47], [12, 45]]
    feature = lambda i, kind, c: {"type": "Feature", "id": i, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("p", "Point", [13, 46]), feature("q", "Polygon", [ring]), feature("m", "MultiPolygon", [[ring], [ring]])]}))
    got = {r.id: r for r in models.read_geojson(spark, str(tmp_path / "g.json")).collect()}
    assert got["p"].parts[0][0].lon == 13 and len(got["q"].parts[0]) == 4 and len(got["m"].parts) == 2
    station = """<FDSNStationXML><Network code="IV"><Station code="ABC"><Channel code="HHZ" locationCode="00" startDate="2020-01-01T00:00:00"><Response><Stage number="1">
      <PolesZeros><NormalizationFactor>2</NormalizationFactor><Pole><Real>-1</Real><Imaginary>2</Imaginary></Pole></PolesZeros><StageGain><Value>1500</Value></StageGain></Stage></Response></Channel></Station></Network></FDSNStationXML>"""
    (tmp_path / "s.xml").write_text(station)
    row = models.read_stationxml(spark, str(tmp_path / "s.xml")).first()
    assert (row.sid, row.stage, row.gain, row.scale, row.poles[0].Imaginary) == ("IV.ABC.00.HHZ", 1, 1500.0, 2.0, 2.0)
