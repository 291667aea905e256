import pytest
from pyspark.errors import PySparkException

from lithoscope.operators import impact


def test_units_of_typologies_without_a_model_count(spark):
    damage = spark.createDataFrame([(1, "a", 3, ["D1"], [0.4, 0.6])], "asset_id long, taxonomy string, n int, levels array<string>, p array<double>")
    typologies = spark.createDataFrame([(1, "a", 3), (1, "unknown", 4)], "asset_id long, taxonomy string, n int")
    assert impact.asset_damage(damage).first().n_units == 3
    row = impact.asset_damage(damage, typologies=typologies).first()
    assert row.n_units == 7 and row.p == pytest.approx([0.4, 0.6]) and row.expected == pytest.approx([1.2, 1.8])


def test_circles_over_the_date_line_raise(spark):
    sites = spark.createDataFrame([(1, -179.99, 0.0)], "site_id long, lon double, lat double")
    events = spark.createDataFrame([(7, 179.99, 0.0)], "event_id long, lon double, lat double")
    with pytest.raises(PySparkException, match="date line"):
        impact.events_near_sites(events, sites, 15.0).collect()


@pytest.mark.parametrize("uniform", [False, True])
def test_scenario_is_the_mixture_of_typologies(spark, uniform):
    """Models of unequal weights, some unusable; typologies without a model; assets without shaking."""
    assets = spark.createDataFrame([(1, 0.2, 0.5), (2, 0.0, 0.5), (3, 0.7, 0.0)], "asset_id long, median double, sigma double")
    typologies = spark.createDataFrame([(1, "a", 3.0), (1, "b", 5.0), (1, "none", 9.0), (2, "a", 1.0), (3, "b", 2.0), (3, "c", 4.0)], "asset_id long, taxonomy string, n double")
    taxonomy = spark.createDataFrame([("a", "m", 0.7), ("a", "k", 0.4), ("b", "k", 2.0), ("b", "m", -1.0), ("b", "k2", float("inf")), ("c", "m", 1.0), ("none", "gone", 1.0)], "taxonomy string, model_id string, weight double")
    fragility = spark.createDataFrame([(m, k, f"D{k}", 0.1 * k + 0.05 * j, 0.6 - 0.1 * k) for j, m in enumerate(("m", "k", "k2")) for k in (1, 2, 3)], "model_id string, level_ord int, level string, theta double, beta double")
    want = {r.asset_id: r for r in impact.asset_damage(impact.typology_damage(assets, typologies, taxonomy, fragility), uniform).collect()}
    got = {r.asset_id: r for r in impact.scenario(assets, typologies, taxonomy, fragility, uniform).collect()}
    assert got.keys() == want.keys() == {1, 2, 3}
    for k, r in want.items():
        assert got[k].p == pytest.approx(r.p, abs=1e-12) and got[k].expected == pytest.approx(r.expected, abs=1e-12)
        assert got[k].levels == r.levels and got[k].n_units == pytest.approx(r.n_units)
    assert impact.scenario(assets, typologies.limit(0), taxonomy, fragility).count() == 0


def test_scenario_stays_in_generated_code(spark):
    assets = spark.createDataFrame([(1, 0.2, 0.5)], "asset_id long, median double, sigma double")
    typologies = spark.createDataFrame([(1, "a", 3.0)], "asset_id long, taxonomy string, n double")
    taxonomy = spark.createDataFrame([("a", "m", 1.0)], "taxonomy string, model_id string, weight double")
    fragility = spark.createDataFrame([("m", 1, "D1", 0.1, 0.5)], "model_id string, level_ord int, level string, theta double, beta double")
    plan = impact.scenario(assets, typologies, taxonomy, fragility)._jdf.queryExecution().optimizedPlan().toString()
    # no array is folded or zipped row by row: probabilities are plain columns, summed by hash
    assert "zip_with" not in plan and "aggregate(" not in plan.lower().replace("aggregate [", "")
