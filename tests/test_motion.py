"""Registered ground-motion models against plain arithmetic."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lithoscope.functions import ground_motion as gm
from lithoscope.operators import motion

SITES = "id int, lon double, lat double, vs30 double, depth double, measured boolean"
#: Made-up coefficients of the regional model.
REGIONAL = {"e1": 3.9, "b1": 2.0, "b2": 0.3, "b3": 0.4, "c1": -1.5, "c2": 0.28, "c3": -0.6, "d0_obs": 2.6, "d1_obs": -0.43, "d0_inf": 1.9, "d1_inf": -0.3, "tau_event_0": 0.44, "tau_l2l": 0.35, "phi_0": 0.47, "phi_s2s_obs": 0.39, "phi_s2s_inf": 0.52}


def sites(spark):
    return spark.createDataFrame([(1, 13.1, 46.2, 400.0, 8.0, True), (2, 12.0, 45.0, 1500.0, 25.0, False), (3, None, 46.0, 500.0, 12.0, True), (4, 13.0, 46.0, 600.0, 15.0, None)], SITES)


def test_names():
    assert motion.resolve("BS2005") is motion.resolve("BragatoSlejko2005")
    assert "Atkinson2015" in motion.registered() and motion.registered() == sorted(motion.registered())
    with pytest.raises(KeyError, match="Nobody"):
        motion.resolve("Nobody1999")
    for name, aliases in (("BS2005", []), ("Fresh", ["Atkinson2015"]), (" ", []), ("Twice", ["Twice"])):
        with pytest.raises(ValueError, match="blank or taken"):
            motion.register(motion.Model(name, motion._atkinson, "epicentral", 760.0, ()), aliases)
    with pytest.raises(ValueError, match="no distance"):
        motion.register(motion.Model("Other", motion._atkinson, "rupture", 760.0, ()))
    assert "Fresh" not in motion.registered()


def test_coefficients_from_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"coefficients": {"default": {"keys": ["c0", "phi"], "type": {"PGA": ["-2.5", "0.3"], "SA-1.00": [1, 2]}}, "other": {"keys": ["c0"], "type": {"IA": [7]}}}}))
    table = motion.read_coefficients(spark, str(path))
    assert {(x["set"], x.imt): x.c for x in table.collect()} == {("default", "PGA"): {"c0": -2.5, "phi": 0.3}, ("default", "SA-1.00"): {"c0": 1.0, "phi": 2.0}, ("other", "IA"): {"c0": 7.0}}
    assert {x.imt for x in motion.measures(table, "Atkinson2015").collect()} == {"PGA", "SA-1.00"}


def test_units_and_hypocentral_distance(spark):
    table = motion.coefficients(spark, {"default": {"PGA": gm.ATKINSON_PGA, "PGV": gm.ATKINSON_PGA}})
    got = {(x.id, x.imt): x for x in motion.ground_motion(sites(spark), table, "Atkinson2015", {"mag": 4.0, "lon": 13.0, "lat": 46.0, "depth": 10.0}, ["PGA", "PGV", "PGA"]).collect()}
    assert len(got) == 8
    c = gm.ATKINSON_PGA
    log10 = c["c0"] + 4 * c["c1"] + 16 * c["c2"] + c["c3"] * math.log10(math.hypot(10.0, max(1.0, 10 ** (-1.72 + 0.43 * 4))))
    assert got[4, "PGV"].ln_mean == pytest.approx(log10 * math.log(10) - math.log(100))
    assert got[4, "PGA"].ln_mean == pytest.approx(log10 * math.log(10) - math.log(100 * gm.GRAVITY))
    assert got[3, "PGA"].ln_mean is None and got[3, "PGA"].sigma == pytest.approx(c["phi"] * math.log(10))


def test_regional_model(spark):
    table = motion.coefficients(spark, {"default": {"PGA": REGIONAL, "PGV": REGIONAL}})
    got = {(x.id, x.imt): x for x in motion.ground_motion(sites(spark), table, "KothaEtAl2020ESHM20", {"mag": 6.0, "lon": 13.0, "lat": 46.0}, ["PGA", "PGV"]).collect()}
    c = REGIONAL

    def plain(h, vs, kind):
        r, ref = h, math.hypot(30.0, h)
        return c["e1"] + c["b3"] * 0.3 + (c["c1"] + c["c2"] * 1.5) * math.log(r / ref) + c["c3"] * (r - ref) / 100 + c[f"d0_{kind}"] + c[f"d1_{kind}"] * math.log(min(vs, 1100.0))

    assert got[4, "PGV"].ln_mean == pytest.approx(plain(8.0, 600.0, "inf"))
    assert got[4, "PGA"].ln_mean == pytest.approx(plain(8.0, 600.0, "inf") - math.log(100 * gm.GRAVITY))
    assert got[1, "PGA"].sigma == pytest.approx(math.sqrt(0.44**2 + 0.35**2 + 0.47**2 + 0.39**2))
    assert got[2, "PGA"].sigma == pytest.approx(math.sqrt(0.44**2 + 0.35**2 + 0.47**2 + 0.52**2))
    with pytest.raises(ValueError, match="needs vs30"):
        motion.ground_motion(sites(spark).drop("vs30"), table, "KothaEtAl2020ESHM20", {"mag": 6.0, "lon": 13.0, "lat": 46.0}, ["PGA"])


def test_missing_measures_clashing_names_and_one_plan(spark):
    table = motion.coefficients(spark, {"epicentral": gm.BRAGATO_SLEJKO_EPICENTRAL})
    event = {"mag": F.col("id") + 3.0, "lon": 13.0, "lat": 46.0}
    other = sites(spark).withColumn("c", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("set", F.lit(0))
    some = motion.ground_motion(other, table, "BS2005", event, ["PGA", "SA-9.99"])
    assert some.count() == 4 and some.columns == [*other.columns, "imt", "ln_mean", "sigma"]
    with pytest.raises(Exception, match="no measure"):
        motion.ground_motion(other, table, "BS2005", event, ["SA-9.99"], strict=True).collect()
    assert motion.ground_motion(other.limit(0), table, "BS2005", event, ["PGA"]).count() == 0
    assert motion.ground_motion(other, table, "BS2005", event, []).count() == 0
    plan = motion.ground_motion(sites(spark), table, "BS2005", event, gm.BRAGATO_SLEJKO_EPICENTRAL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
