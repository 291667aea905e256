"""Scenario impact: assets, their typologies, weighted fragility models and ground motion to expected damage.

Frames, all keyed and joined by Spark:

* assets: asset_id, lon, lat, elevation
* typologies: asset_id, taxonomy, n (units)
* taxonomy_map: taxonomy, model_id, weight
* fragility: model_id, level_ord (from 1), level, theta, beta

and an event: its magnitude, lon and lat.

The maps of models grow with the vocabulary of building types, not with the
assets, so Spark's own size check decides whether they are broadcast.  Ground
motion is worked out once for each asset.  Within an asset everything that
follows is narrow: probabilities of all levels of a model travel in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fragility as fr
from ..functions import geo
from ..functions import ground_motion as gm

TAIL, NONE = "GT_LAST", "D0"


def ground_motion(assets: DataFrame, mag: float, lon: float, lat: float, coefficients: dict = gm.BRAGATO_SLEJKO_PGA) -> DataFrame:
    """``assets`` with median (g) and sigma (natural log) of the event's acceleration."""
    km = geo.great_circle(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)) / 1000
    mean, sigma = gm.bragato_slejko_2005(F.lit(mag), km, coefficients)
    return assets.withColumn("median", F.exp(mean)).withColumn("sigma", sigma)


def events_near_sites(events: DataFrame, sites: DataFrame, most_km: float, cell_deg: float = 1.0) -> DataFrame:
    """Pairs of events (lon, lat and what else they have) and sites (site_id, lon, lat) within a distance, with km.

    An equi-join on cells: an event goes to every cell its circle can touch, a
    site to its own, so no pair is looked at outside them.  Events whose circle
    reaches a pole or the date line raise an error.
    """
    reach = most_km / 111.0
    wide = reach / F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(89.0))))
    outside = (F.abs("lat") + reach > 90) | (F.abs("lon") + wide > 180)
    events = events.withColumn("lon", F.when(outside, F.raise_error(F.lit("an event's circle reaches a pole or the date line")).cast("double")).otherwise(F.col("lon")))
    cells = lambda c, r: F.sequence(F.floor((F.col(c) - r) / cell_deg), F.floor((F.col(c) + r) / cell_deg))
    kept = [c for c in events.columns if c not in ("lon", "lat")]
    spread = events.select(*kept, F.col("lon").alias("e_lon"), F.col("lat").alias("e_lat"), F.explode(cells("lon", wide)).alias("x"), cells("lat", F.lit(reach)).alias("ys"))
    spread = spread.withColumn("y", F.explode("ys")).drop("ys")
    own = sites.select("site_id", "lon", "lat", F.floor(F.col("lon") / cell_deg).alias("x"), F.floor(F.col("lat") / cell_deg).alias("y"))
    km = geo.great_circle(F.col("lon"), F.col("lat"), F.col("e_lon"), F.col("e_lat")) / 1000
    return spread.join(own, ["x", "y"]).withColumn("km", km).where(F.col("km") <= most_km).select(*kept, "site_id", "km")


def models(fragility: DataFrame) -> DataFrame:
    """model_id, curves: the levels of each model in order."""
    return fragility.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("level_ord", "level", "theta", "beta"))).alias("curves"))


def exceedance(curves: Column, median: Column, sigma: Column) -> Column:
    """Probabilities of exceedance by level, never rising from one level to the next."""
    # the deviate is worked out once for each level, as the distribution function names it many times
    z = F.transform(curves, lambda c: F.log(median / c["theta"]) / F.sqrt(c["beta"] * c["beta"] + sigma * sigma))
    return fr.monotone(F.transform(z, lambda x: F.when(median > 0, fr.norm_cdf(x)).otherwise(0.0)))


def weighted_mean(pairs: Column) -> Column:
    """Mean of equally long arrays ``p`` with weights ``w``; weights that are not positive and finite are left out."""
    used = F.filter(pairs, lambda x: (x["w"] > 0) & (x["w"] < float("inf")))
    total = F.aggregate(used, F.lit(0.0), lambda s, x: s + x["w"])
    zero = F.transform(F.element_at(used, 1)["p"], lambda _: F.lit(0.0))
    summed = F.aggregate(used, zero, lambda s, x: F.zip_with(s, x["p"], lambda a, b: a + b * x["w"]))
    return F.when(F.size(used) > 0, F.transform(summed, lambda v: v / total))


def typology_damage(assets: DataFrame, typologies: DataFrame, taxonomy_map: DataFrame, fragility: DataFrame, skip_missing: bool = True) -> DataFrame:
    """asset_id, taxonomy, n, levels, p: state probabilities of each typology (first level's complement up to the tail).

    Typologies without a model are left out, or raise with ``skip_missing=False``.
    """
    curves = models(fragility)
    resolved = taxonomy_map.join(curves, "model_id")
    how = "inner" if skip_missing else "left"
    rows = typologies.join(resolved, "taxonomy", how).join(assets, "asset_id")
    if not skip_missing:
        rows = rows.withColumn("curves", F.when(F.col("curves").isNull(), F.raise_error(F.concat(F.lit("no fragility model for "), "taxonomy"))).otherwise(F.col("curves")))
    rows = rows.withColumn("p", fr.states(exceedance(F.col("curves"), F.col("median"), F.col("sigma"))))
    levels = F.transform("curves", lambda c: c["level"])
    return (
        rows.groupBy("asset_id", "taxonomy", "n")
        .agg(F.array_sort(F.collect_list(F.struct("model_id", F.col("weight").alias("w"), "p"))).alias("branches"), F.first(levels).alias("levels"))
        .select("asset_id", "taxonomy", "n", "levels", weighted_mean(F.col("branches")).alias("p"))
    )


def asset_damage(damage: DataFrame, uniform: bool = False, typologies: DataFrame | None = None) -> DataFrame:
    """asset_id, n_units, levels, p (mean over typologies, by units or uniform) and expected (units) by state.

    n_units counts the units of all ``typologies`` (asset_id, n) where they are
    given, those without a model too, and of the ones with a model otherwise.
    """
    w = F.lit(1.0) if uniform else F.col("n").cast("double")
    mixed = damage.groupBy("asset_id").agg(
        F.sum("n").alias("n_units"),
        F.first("levels").alias("levels"),
        F.array_sort(F.collect_list(F.struct("taxonomy", w.alias("w"), "p", F.transform("p", lambda x: x * F.col("n")).alias("e")))).alias("parts"),
    )
    zero = F.transform(F.element_at("parts", 1)["e"], lambda _: F.lit(0.0))
    expected = F.aggregate("parts", zero, lambda s, x: F.zip_with(s, x["e"], lambda a, b: a + b))
    if typologies is not None:
        mixed = mixed.drop("n_units").join(typologies.groupBy("asset_id").agg(F.sum("n").alias("n_units")), "asset_id")
    return mixed.select("asset_id", "n_units", "levels", weighted_mean(F.col("parts")).alias("p"), expected.alias("expected"))


def scenario(assets: DataFrame, typologies: DataFrame, taxonomy_map: DataFrame, fragility: DataFrame, uniform: bool = False) -> DataFrame:
    """What ``asset_damage`` makes of ``typology_damage``, with each model worked out once for an asset.

    Mixing is linear, so the units that an asset's typologies give a model are added
    up first; probabilities of a level are plain columns, in generated code.
    Typologies without a model are left out, and weights that are not positive and
    finite; models of one asset have levels alike.
    """
    usable = lambda w: (w > 0) & (w < float("inf"))
    weighted = taxonomy_map.join(fragility.select("model_id").distinct(), "model_id", "left_semi").where(usable(F.col("weight")))
    shares = weighted.join(weighted.groupBy("taxonomy").agg(F.sum("weight").alias("total")), "taxonomy").select("taxonomy", "model_id", (F.col("weight") / F.col("total")).alias("share"))
    n = F.col("n").cast("double")
    mixing = F.lit(1.0) if uniform else F.when(usable(n), n).otherwise(0.0)
    held = typologies.join(shares, "taxonomy").groupBy("asset_id", "model_id").agg(F.sum(n * F.col("share")).alias("units"), F.sum(mixing * F.col("share")).alias("mix"))
    # as many columns as a damage scale has levels
    most = fragility.agg(F.max("level_ord")).first()[0] or 0
    curves = fragility.groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level_ord", "level"))), lambda x: x["level"]).alias("levels"), *[F.max(F.when(F.col("level_ord") == k + 1, F.col(c))).alias(f"{c}{k}") for k in range(most) for c in ("theta", "beta")])
    rows = held.join(curves, "model_id").join(assets.select("asset_id", "median", "sigma"), "asset_id")
    rows = rows.select("*", *[(F.log(F.col("median") / F.col(f"theta{k}")) / F.sqrt(F.col(f"beta{k}") * F.col(f"beta{k}") + F.col("sigma") * F.col("sigma"))).alias(f"z{k}") for k in range(most)])
    rows = rows.select("asset_id", "units", "mix", "levels", *[F.when(F.col(f"theta{k}").isNotNull(), F.when(F.col("median") > 0, fr.norm_cdf(F.col(f"z{k}"))).otherwise(0.0)).alias(f"e{k}") for k in range(most)])
    # exceedance never rises from one level to the next
    rows = rows.select("asset_id", "units", "mix", "levels", *[F.least(*[F.col(f"e{j}") for j in range(k + 1)]).alias(f"e{k}") if k else F.col("e0") for k in range(most)])
    edges = [F.lit(1.0), *[F.when(F.size("levels") > k, F.col(f"e{k}")).otherwise(0.0) for k in range(most)], F.lit(0.0)]
    states = [edges[k] - edges[k + 1] for k in range(most + 1)]
    done = rows.groupBy("asset_id").agg(
        F.round(F.sum("units"), 9).alias("n_units"),
        F.first("levels").alias("levels"),
        F.sum("mix").alias("mix"),
        *[F.sum(F.col(w) * p).alias(f"{w}{k}") for k, p in enumerate(states) for w in ("units", "mix")],
    )
    sums = lambda w: F.slice(F.array(*[F.col(f"{w}{k}") for k in range(most + 1)]), F.lit(1), F.size("levels") + 1)
    mixed = F.when(F.col("mix") > 0, F.transform(sums("mix"), lambda x: x / F.col("mix")))
    return done.select("asset_id", "n_units", "levels", mixed.alias("p"), sums("units").alias("expected"))


def by_level(result: DataFrame) -> DataFrame:
    """One row for each asset and state: level (of what is not exceeded, and the tail), prob, expected."""
    names = F.concat("levels", F.array(F.lit(TAIL)))
    return result.select("asset_id", F.posexplode(F.arrays_zip(names.alias("level"), F.col("p").alias("prob"), F.col("expected"))).alias("ord", "x")).select("asset_id", "ord", "x.*")


def summary(result: DataFrame) -> DataFrame:
    """level, assets, expected: totals over all assets."""
    return by_level(result).groupBy("ord", "level").agg(F.count("*").alias("assets"), F.sum("expected").alias("expected"))


def with_geometry(result: DataFrame, geometry: DataFrame) -> DataFrame:
    """Left join of features (id, geometry) by id; ``1.0`` and ``1`` are the same id."""
    same = lambda c: F.regexp_replace(c.cast("string"), r"\.0+$", "")
    return result.withColumn("_id", same(F.col("asset_id"))).join(geometry.select(same(F.col("id")).alias("_id"), "geometry"), "_id", "left").drop("_id")
