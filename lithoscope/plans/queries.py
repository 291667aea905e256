"""Registered queries over the test tables; the SQL of each is in ``oracle``."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fragility as fr
from ..functions import geo, hazard, site, time
from ..functions import ground_motion as gm
from ..operators import catalogue as cat
from ..operators import hazard as hz
from ..operators import exposure, impact, instruments, layered, mesh, motion, noise, order, records, recursive, sampling, scattered, waveform
from ..streaming import streams
from . import views

EVENT = {"mag": 5.5, "lon": 13.0, "lat": 46.0}
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    FOUND[f.__name__] = f
    return f


def r(x: Column, places: int = 6) -> Column:
    return F.round(x, places)


# impact


def _result(spark: SparkSession, d: str, uniform: bool = False) -> DataFrame:
    assets = impact.ground_motion(views.sites(spark, d), **EVENT)
    return impact.scenario(assets, views.typologies(spark, d), views.taxonomy_map(spark, d), views.fragility(spark, d), uniform)


@query
def impact_summary(spark, d):
    return impact.summary(_result(spark, d)).select("level", "assets", r(F.col("expected"), 3).alias("expected"))


@query
def impact_assets(spark, d):
    return impact.by_level(_result(spark, d)).select("asset_id", "level", r(F.col("prob")).alias("prob"), r(F.col("expected"), 4).alias("expected"))


@query
def impact_uniform_mix(spark, d):
    return impact.by_level(_result(spark, d, uniform=True)).select("asset_id", "level", r(F.col("prob")).alias("prob"))


@query
def impact_top10(spark, d):
    worst = F.element_at("expected", -1) + F.element_at("expected", -2)
    return _result(spark, d).select("asset_id", r(worst, 4).alias("d5_tail")).orderBy(F.desc("d5_tail"), "asset_id").limit(10)


@query
def impact_typology_breakdown(spark, d):
    assets = impact.ground_motion(views.sites(spark, d), **EVENT)
    damage = impact.typology_damage(assets, views.typologies(spark, d), views.taxonomy_map(spark, d), views.fragility(spark, d))
    names = F.concat("levels", F.array(F.lit(impact.TAIL)))
    states = F.explode(F.arrays_zip(names.alias("level"), F.col("p").alias("prob")))
    return damage.select("asset_id", "taxonomy", states.alias("x")).select("asset_id", "taxonomy", "x.level", r(F.col("x.prob")).alias("prob"))


@query
def impact_skip_taxonomy(spark, d):
    """Units of all typologies, and those that have a model and so a damage."""
    assets, typologies = impact.ground_motion(views.sites(spark, d), **EVENT), views.typologies(spark, d)
    damage = impact.typology_damage(assets, typologies, views.taxonomy_map(spark, d), views.fragility(spark, d))
    covered = F.aggregate("expected", F.lit(0.0), lambda s, x: s + x)
    return impact.asset_damage(damage, typologies=typologies).select("asset_id", "n_units", r(covered, 3).alias("covered"))


@query
def gm_assets(spark, d):
    return impact.ground_motion(views.sites(spark, d), **EVENT).select("asset_id", r(F.col("median"), 9).alias("median"), r(F.col("sigma"), 9).alias("sigma"))


@query
def gm_measures(spark, d):
    """Four measures of a registered model at every site, in one plan."""
    table = motion.coefficients(spark, {"epicentral": gm.BRAGATO_SLEJKO_EPICENTRAL})
    found = motion.ground_motion(views.sites(spark, d), table, "BS2005", EVENT, gm.BRAGATO_SLEJKO_EPICENTRAL)
    return found.select("asset_id", "imt", r(F.col("ln_mean"), 7).alias("ln_mean"), r(F.col("sigma"), 7).alias("sigma"))


@query
def gm_events_near_sites(spark, d):
    """Events and sites meet once for each of their places, so pairs do not grow with the tables where places recur."""
    events = views.locations(spark, d).groupBy((F.col("depth") / 10 + 3).alias("mag"), "lon", "lat").agg(F.count("*").alias("n"))
    sites = views.sites(spark, d)
    pairs = impact.events_near_sites(events, sites.select(F.struct("lon", "lat").alias("site_id"), "lon", "lat").distinct(), 15.0, 0.25)
    mean, _ = gm.atkinson_2015(F.col("mag"), F.sqrt(F.col("km") * F.col("km") + 100), gm.ATKINSON_PGA)
    places = pairs.groupBy("site_id").agg(F.sum("n").alias("events"), r(F.max(F.exp(mean)), 9).alias("pga")).select("site_id.lon", "site_id.lat", "events", "pga")
    return sites.join(places, ["lon", "lat"]).select(F.col("asset_id").alias("site_id"), "events", "pga")


@query
def frag_distribution(spark, d):
    values = F.array(*(F.struct(F.lit(x).alias("im"), F.lit(p).alias("p")) for x, p in ((0.05, 1.0), (0.1, 2.0), (0.3, 1.0))))
    poe = fr.distribution_poe(values, lambda im: fr.lognormal_poe(im, F.col("theta"), F.col("beta")))
    return views.fragility(spark, d).select("model_id", "level", r(poe, 9).alias("poe"))


@query
def frag_tabulated(spark, d):
    table = F.array(*(F.struct(F.lit(x).alias("im"), F.lit(p).alias("poe")) for x, p in ((10.0, 0.0), (50.0, 0.2), (200.0, 0.7), (400.0, 1.0))))
    return views.table(spark, d, "events").select("event_id", r(fr.tabulated_poe(F.col("value"), table)).alias("poe"), r(fr.tabulated_poe(F.col("value"), table, True)).alias("poe_log"))


# catalogue


@query
def cat_prime(spark, d):
    p = cat.prime(F.col("magnitudes"))
    return views.catalogue(spark, d).select("event_id", p["size"].alias("size"), p["type"].alias("type"))


def _filtered(operator: str):
    def run(spark, d):
        return cat.filter_solutions(views.catalogue(spark, d), "size", operator, 2.5).select("event_id", F.size("magnitudes").cast("long").alias("n"))

    return run


for _name in cat.OPERATORS:
    FOUND[f"cat_filter_{_name}"] = _filtered(_name)


@query
def cat_filter_keep_empty(spark, d):
    return cat.filter_solutions(views.catalogue(spark, d), "size", "gt", 4.5, delete_empty=False).select("event_id", F.size("magnitudes").cast("long").alias("n"))


@query
def cat_range(spark, d):
    return cat.value_range(views.catalogue(spark, d), "size")


@query
def cat_values(spark, d):
    return cat.values(views.catalogue(spark, d), "depth")


def _split(spark, d):
    """A stored half of the catalogue, and new events of which some are known."""
    whole = views.catalogue(spark, d)
    return whole.where("event_id % 4 < 2"), whole.where("event_id % 4 > 0")


@query
def cat_append_new(spark, d):
    return cat.append(*_split(spark, d))[0].select("event_id", F.size("magnitudes").cast("long").alias("n"))


@query
def cat_append_skipped(spark, d):
    return cat.append(*_split(spark, d))[1].select("event_id")


@query
def cat_upsert(spark, d):
    p = cat.prime(F.col("magnitudes"))
    return cat.upsert(*_split(spark, d)).select("event_id", F.size("magnitudes").cast("long").alias("n"), p["size"].alias("size"))


def _fifth() -> Column:
    return F.floor(F.col("event_id") / 5) * 5


def _magnitudes_left(df):
    p = cat.prime(F.col("magnitudes"))
    return df.select("event_id", F.size("magnitudes").cast("long").alias("n"), p["size"].alias("size"))


@query
def cat_sort(spark, d):
    """Events by the size of their preferred magnitude, with their place in that order."""
    ordered = cat.sort_by(views.catalogue(spark, d), "size").select("event_id", F.size("magnitudes").cast("long").alias("n"), cat.prime(F.col("magnitudes"))["size"].alias("size"))
    return order.placed(ordered)


@query
def haz_completeness_order(spark, d):
    """The completeness table, its large magnitudes entered again with their first year, in order of magnitude and in order of year."""
    table = _completeness(spark, d)
    edited = hz.add_entries(table, hz.at_magnitude(table, 4.5).withColumn("year_end", F.col("year_start")))
    columns = ["magnitude", "year_start", "year_end"]
    both = [order.placed(f(edited).select(*columns, r(F.col("completeness"), 9).alias("completeness"))).withColumn("by", F.lit(name)) for name, f in (("magnitude", hz.by_magnitude), ("year", hz.by_year))]
    return both[0].union(both[1])


@query
def cat_remove(spark, d):
    return _magnitudes_left(cat.remove(views.catalogue(spark, d), _fifth()))


@query
def cat_get_event(spark, d):
    return _magnitudes_left(cat.get_event(views.catalogue(spark, d), _fifth()))


@query
def cat_add_magnitude(spark, d):
    """A preferred magnitude more for every fifth event."""
    whole = views.catalogue(spark, d)
    kind, given = whole.schema["magnitudes"].dataType.elementType, {"size": 9.5, "prime": True}
    solution = F.struct(*(F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in kind.fields))
    return _magnitudes_left(cat.add_solution(whole, _fifth(), solution))


@query
def cat_remove_solution(spark, d):
    """Without the first magnitude of every fifth event."""
    out = cat.remove_solution(views.catalogue(spark, d), _fifth(), 0)
    return out.select("event_id", F.size("magnitudes").cast("long").alias("n"), F.aggregate("magnitudes", F.lit(0.0), lambda s, m: s + m["size"]).alias("total")).withColumn("total", r(F.col("total"), 3))


@query
def cat_hypocentre(spark, d):
    return views.catalogue(spark, d).select("event_id", cat.hypocentre(cat.prime(F.col("locations"))).alias("h")).select("event_id", r(F.col("h.lon")).alias("lon"), r(F.col("h.lat")).alias("lat"), "h.elevation")


# geodesy


@query
def geo_distances(spark, d):
    a = (F.col("lon"), F.col("lat"))
    b = (F.lit(13.25), F.lit(46.1))
    return views.locations(spark, d).select(
        "event_id",
        r(geo.great_circle(*a, *b), 3).alias("great_circle"),
        r(geo.chord(*a, *b), 2).alias("chord"),
        r(geo.hypocentral(*a, -F.col("depth") * 1000, *b, F.lit(0.0)), 3).alias("ellipsoid"),
        r(geo.hypocentral(*a, -F.col("depth") * 1000, *b, F.lit(0.0), ellipsoid=False), 3).alias("sphere"),
        r(geo.azimuth(*a, *b)).alias("azimuth"),
    )


@query
def geo_projections(spark, d):
    x, y = geo.sinusoidal(F.col("lon"), F.col("lat"))
    e, n, u = geo.enu(F.col("lon"), F.col("lat"), F.lit(0.0), F.lit(13.0), F.lit(46.0), F.lit(0.0))
    east, north = geo.utm(F.col("lon"), F.col("lat"))
    return views.sites(spark, d).select(
        "asset_id", r(x, 3).alias("x"), r(y, 3).alias("y"), r(e, 3).alias("e"), r(n, 3).alias("n"), r(u, 3).alias("u"), r(east, 3).alias("east"), r(north, 3).alias("north"), r(geo.geocentric_radius(F.col("lat")), 3).alias("radius"),
        r(geo.normalize_longitude(F.col("lon") * 40)).alias("lon"),
    )


@query
def geo_from_enu(spark, d):
    """Hypocentres in a local frame and back."""
    origin = (F.lit(13.0), F.lit(46.0), F.lit(250.0))
    lon, lat, elevation = geo.from_enu(*geo.enu(F.col("lon"), F.col("lat"), -F.col("depth") * 1000, *origin), *origin)
    return views.locations(spark, d).select("event_id", r(lon).alias("lon"), r(lat).alias("lat"), r(elevation + 1, 3).alias("above"))


@query
def geo_boxes(spark, d):
    """Box and mean point of a triangle at each site."""
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    ring = F.array(corner(0.0, 0.0), corner(0.1, 0.0), corner(0.0, 0.2))
    columns = (*geo.bounding_box(ring), *geo.mean_point(ring))
    return views.sites(spark, d).select("asset_id", *(r(c).alias(n) for c, n in zip(columns, ("west", "south", "east", "north", "lon", "lat"))))


RING = ((12.5, 45.5), (15.0, 45.7), (14.0, 47.5), (13.4, 46.2), (12.8, 47.0))


@query
def geo_in_polygon(spark, d):
    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in RING))
    return views.sites(spark, d).where(geo.in_ring(ring, F.col("lon"), F.col("lat"))).select("asset_id", r(geo.polygon_area(ring) / 1e6, 3).alias("area"))


@query
def geo_polygon_samples(spark, d):
    """Points drawn around every site, from a square with a hole: all of them lie in it, none in the hole."""
    ring = lambda h: F.array(*(F.struct((F.col("lon") + x * h).alias("lon"), (F.col("lat") + y * h).alias("lat")) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    sites = views.sites(spark, d)
    points = sampling.on_sphere(sites.select(F.col("asset_id").alias("id"), F.array(F.array(ring(0.1), ring(0.05))).alias("parts"), (F.col("asset_id") % 40 + 1).alias("n")), seed=1)
    off_lat = F.abs(F.col("p_lat") - F.col("lat"))
    # sides between equal longitudes are straight in the projection, and bend by less than 1e-4 degrees on the map
    off_lon = F.abs(F.col("p_lon") - F.col("lon"))
    joined = points.select(F.col("id").alias("asset_id"), "k", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")).join(sites, "asset_id")
    within, hole = (off_lon < 0.1 + 1e-4) & (off_lat < 0.1 + 1e-9), (off_lon < 0.05 - 1e-4) & (off_lat < 0.05 - 1e-9)
    return joined.groupBy("asset_id").agg(F.count_distinct("k").alias("n"), F.count_if(within).alias("within"), F.count_if(hole).alias("in_hole"))


@query
def mesh_cells(spark, d):
    """Sites by cell of a regular mesh over all of them."""
    sites = views.sites(spark, d)
    box = sites.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    step, origin = 0.25, (box[0], box[2])
    x, y = mesh.cell("lon", origin[0], step).alias("x"), mesh.cell("lat", origin[1], step).alias("y")
    grid = mesh.cartesian(spark, (box[0], box[1]), (box[2], box[3]), step, step).select("id", x, y)
    return grid.join(sites.groupBy(x, y).agg(F.count("*").alias("n")), ["x", "y"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query
def grid_interpolation(spark, d):
    """Shaking on a regular grid of events, at the sites."""
    grid = views.locations(spark, d).groupBy((F.floor(F.col("lon") * 4 + 1e-9) / 4).alias("lon"), (F.floor(F.col("lat") * 4 + 1e-9) / 4).alias("lat")).agg(F.avg("depth").alias("value"))
    return mesh.grid_values(grid, views.sites(spark, d).drop("elevation"), (0.0, 0.0), 0.25).select("asset_id", r(F.col("value")).alias("value"))


@query
def gm_scattered(spark, d):
    """Balances of suppliers as measurements at scattered stations, at the sites."""
    found = scattered.scattered_values(views.stations(spark, d), views.sites(spark, d).drop("elevation"), ["a", "b"])
    return found.select("asset_id", r(F.col("a"), 5).alias("a"), r(F.col("b"), 5).alias("b"))


# exposure


@query
def exposure_group_by(spark, d):
    parts = views.table(spark, d, "part").select("p_brand", F.when(F.col("p_size") > 10, F.col("p_size") / 10).alias("lon"), (F.col("p_size") / 5).alias("lat"), F.col("p_type").alias("taxonomy"), (F.col("p_size") % 3).alias("number"), F.col("p_partkey").alias("seq"))
    out = exposure.grouped(parts, "p_brand")
    return out.select("asset_id", "lon", "lat", "aggregated", F.size("typologies").cast("long").alias("n"), F.element_at("typologies", -1)["taxonomy"].alias("last"))


@query
def exposure_taxonomies(spark, d):
    return exposure.taxonomies(views.typologies(spark, d))


@query
def exposure_branches(spark, d):
    return exposure.branches(views.typologies(spark, d), views.taxonomy_map(spark, d)).groupBy("taxonomy", "model_id").agg(F.count("*").alias("assets"), F.sum("n").alias("units"))


# hazard


@query
def haz_rates(spark, d):
    m = F.col("s_suppkey") % 50 / 10 + 3
    moment = hazard.magnitude_to_moment(m)
    return views.table(spark, d, "supplier").select(
        "s_suppkey",
        r(hazard.poisson_probability(F.col("s_suppkey") / 1000), 9).alias("p"),
        r(hazard.poisson_rate(F.col("s_suppkey") % 90 / 100), 9).alias("rate"),
        r(hazard.bounded_cumulative_rate(m, F.lit(4.0), F.lit(1.0), F.lit(7.0)), 9).alias("gr"),
        r(hazard.moment_to_magnitude(moment), 6).alias("mw"),
        r(hazard.ml_iaspei(F.col("s_suppkey") + 1.0, F.col("s_suppkey") + 10.0), 6).alias("ml"),
        r(hazard.ml_hutton_boore(F.col("s_suppkey") + 1.0, F.col("s_suppkey") + 10.0), 6).alias("ml_hb"),
    )


@query
def haz_scaling(spark, d):
    style = F.when(F.col("p_size") % 4 == 0, "normal").when(F.col("p_size") % 4 == 1, "reverse").when(F.col("p_size") % 4 == 2, "strike-slip").otherwise("generic")
    return views.table(spark, d, "part").select("p_partkey", r(hazard.area_to_magnitude(F.col("p_retailprice"), style)).alias("m"), r(hazard.baker_jayaram(F.col("p_size") / 50 + 0.02, F.lit(0.15))).alias("rho"))


@query
def haz_b_value(spark, d):
    return hz.aki_b_value(views.magnitudes(spark, d).select(F.col("size").alias("m")), 1.0).select("n", r(F.col("b"), 9).alias("b"), r(F.col("b_sigma"), 9).alias("b_sigma"))


@query
def haz_histogram(spark, d):
    return hz.magnitude_histogram(views.magnitudes(spark, d).select(F.col("size").alias("m")), 0.5, 1.0).select(r(F.col("m")).alias("m"), "n")


@query
def haz_weichert(spark, d):
    mags = views.magnitudes(spark, d).where("size >= 2").withColumn("m", F.floor(F.col("size") * 2) / 2 + 0.25)
    found = hz.weichert(mags.groupBy("m").agg(F.count("*").alias("n")).withColumn("years", 20 + 10 * F.col("m")))
    return spark.createDataFrame([(found["b"], found["b_sigma"], found["rate"], found["a"])], "b double, b_sigma double, rate double, a double")


def _completeness(spark, d):
    return views.table(spark, d, "part").select((F.col("p_size") / 10).alias("magnitude"), (1900 + F.col("p_partkey") % 80).alias("year_start"), (1950 + F.col("p_partkey") % 70).alias("year_end"), (F.col("p_size") / 50).alias("completeness"))


@query
def haz_completeness_year(spark, d):
    return hz.in_force(_completeness(spark, d), 1960).groupBy("magnitude").agg(F.count("*").alias("n"))


@query
def haz_completeness_magnitude(spark, d):
    return hz.at_magnitude(_completeness(spark, d), 2.5).groupBy("magnitude", "year_start").agg(F.count("*").alias("n"))


@query
def haz_completeness_edit(spark, d):
    """Old entries count for half, small magnitudes go, and large ones are entered again from their first year on."""
    table = _completeness(spark, d)
    edited = hz.remove_entries(hz.update_entries(table, F.col("year_start") < 1910, completeness=0.5), F.col("magnitude") < 1)
    edited = hz.add_entries(edited, hz.at_magnitude(table, 4.5).withColumn("year_end", F.col("year_start")))
    return hz.by_magnitude(edited).groupBy("magnitude").agg(F.count("*").alias("n"), r(F.avg("completeness"), 6).alias("completeness"), F.sum("year_end").alias("years"))


@query
def haz_completeness_average(spark, d):
    return hz.average_completeness(_completeness(spark, d)).select(r(F.col("completeness"), 9).alias("completeness"))


# waveforms


def _w(spark, d):
    return views.wave(spark, d)


@query
def sig_demean(spark, d):
    return waveform.demean(_w(spark, d)).select("sid", "i", r(F.col("v")).alias("v"))


@query
def sig_integral(spark, d):
    return waveform.cumulative_trapezoid(_w(spark, d), F.col("v"), 0.5).select("sid", "i", r(F.col("integral"), 4).alias("integral"))


@query
def sig_gradient(spark, d):
    return waveform.gradient(_w(spark, d), 0.5).select("sid", "i", r(F.col("slope")).alias("slope"))


@query
def sig_peak(spark, d):
    return waveform.peak(_w(spark, d)).select("sid", r(F.col("peak")).alias("peak"), "i")


@query
def sig_intensity(spark, d):
    w = _w(spark, d)
    out = waveform.arias_intensity(w, 0.01).join(waveform.cumulative_absolute_velocity(w, 0.01), "sid").join(waveform.root_mean_square(w, 0.01), "sid")
    return out.select("sid", r(F.col("arias"), 2).alias("arias"), r(F.col("cav"), 3).alias("cav"), r(F.col("rms"), 3).alias("rms"))


@query
def sig_durations(spark, d):
    w = _w(spark, d)
    out = waveform.significant_duration(w, 0.01).withColumnRenamed("duration", "significant").join(waveform.bracketed_duration(w, 200.0, 0.01), "sid")
    return out.select("sid", r(F.col("significant")).alias("significant"), r(F.col("duration")).alias("bracketed"))


@query
def sig_moving_rms(spark, d):
    return waveform.moving_rms(_w(spark, d), 3).select("sid", "i", r(F.col("rms"), 4).alias("rms"))


@query
def sig_split_windows(spark, d):
    return waveform.split_windows(_w(spark, d), 16, 8).groupBy("sid", "w").agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean"))


@query
def sig_taper(spark, d):
    return waveform.taper(_w(spark, d), 0.2).select("sid", "i", r(F.col("v")).alias("v"))


@query
def sig_segments(spark, d):
    return waveform.segments(_w(spark, d), 3600.0).select("sid", "segment", "begin", "end", "n")


@query
def sig_later_wins(spark, d):
    return waveform.later_wins(_w(spark, d), 86400.0).select("sid", "cell", r(F.col("v")).alias("v"), "n")


@query
def sig_cut(spark, d):
    return waveform.cut(_w(spark, d), 1_704_070_000.0, 1_704_500_000.0).select("sid", "i")


@query
def sig_overlaps(spark, d):
    return waveform.overlapping(waveform.segments(_w(spark, d), 3600.0), 1_704_070_000.0, 1_704_500_000.0).groupBy("sid").agg(F.count("*").alias("records"))


@query
def sig_resonance(spark, d):
    return waveform.spectral_peaks(_w(spark, d)).groupBy("sid").agg(F.count("*").alias("peaks"), F.min("i").alias("first"))


@query
def resp_epoch_join(spark, d):
    epochs = views.table(spark, d, "customer").select((F.col("c_custkey") % 150).alias("sid"), (1_704_067_200.0 + F.col("c_custkey") * 600).alias("start"), (1_704_067_200.0 + F.col("c_custkey") * 600 + 86400).alias("end"), F.col("c_custkey").alias("stage"))
    return waveform.epoch_join(_w(spark, d), epochs).groupBy("stage").agg(F.count("*").alias("samples"))


# sites


@query
def resp_transfer(spark, d):
    """A pole and a two-point filter for each supplier, at three frequencies."""
    found = instruments.channel_response(views.instruments(spark, d), (0.5, 2.0, 10.0))
    return found.select("sid", "freq", r(F.col("amplitude"), 9).alias("amplitude"), r(F.col("phase"), 9).alias("phase"))


@query
def site_parameters(spark, d):
    layers = F.col("layers")
    v30 = site.vs30(layers)
    top, base = F.element_at(layers, 1), F.element_at(layers, -1)
    return views.profiles(spark, d).select(
        "site",
        r(v30).alias("vs30"),
        r(site.depth_average(layers, lambda x: x["vs"], F.lit(50.0))).alias("vs50"),
        r(site.site_kappa(layers), 9).alias("kappa"),
        site.soil_class(v30).alias("ec8"),
        site.soil_class(v30, "NEHRP").alias("nehrp"),
        r(site.impedance_amplification(top["vs"], top["dn"], base["vs"], base["dn"])).alias("amplification"),
        r(site.quarter_wavelength_depth(layers, F.lit(1.0))).alias("qwl"),
        r(site.attenuation_decay(F.lit(5.0), site.site_kappa(layers))).alias("decay"),
    )


@query
def site_log_statistics(spark, d):
    logs = F.log(100 + F.col("p_retailprice") / 4)
    return views.table(spark, d, "part").groupBy(F.col("p_type").alias("site")).agg(r(F.exp(F.avg(logs))).alias("mean"), r(F.exp(F.stddev_pop(logs))).alias("deviation"))


# dates


@query
def time_parts(spark, d):
    ts = F.col("o_orderdate")
    return views.table(spark, d, "orders").select(
        "o_orderkey",
        time.seconds_since_year_one(ts).alias("seconds"),
        time.ordinal_day(ts).cast("long").alias("day"),
        time.iso(ts, 3).alias("iso"),
        time.leap(F.year(ts)).alias("leap"),
        time.seconds_since_year_one(time.shifted(ts, F.lit(2), "d")).alias("later"),
        (time.from_seconds(time.seconds_since_year_one(ts)) == ts).alias("back"),
    )


# records


@query
def noise_spectral_ratio(spark, d):
    """Each source's samples over the one before them, by frequency, over half overlapping windows."""
    before = F.coalesce(F.lag("v").over(Window.partitionBy("sid").orderBy("i")), F.lit(0.0))
    pairs = _w(spark, d).select("sid", "i", F.col("v").alias("top"), before.alias("base"))
    out = noise.mean_ratio(pairs, 0.5, 8, 4, taper=2)
    return out.select("sid", "freq", r(F.col("amplitude"), 4).alias("amplitude"), r(F.col("spread"), 4).alias("spread"), "windows")


@query
def noise_directions(spark, d):
    """Dominant direction of a spectrum for each supplier, and the power along it."""
    lines = views.table(spark, d, "lineitem")
    spectra = lines.select(F.col("l_suppkey").alias("sid"), F.col("l_orderkey").alias("k"), (F.col("l_quantity") - 20).alias("xr"), (F.col("l_linenumber") - 3.0).alias("xi"), (F.col("l_quantity") / 2).alias("yr"), (F.col("l_orderkey") % 7 - 2.0).alias("yi"))
    power = F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return noise.combined_directions(spectra).groupBy("sid").agg(r(F.first("theta"), 6).alias("theta"), r(power, 3).alias("power"))


@query
def sig_spectrum(spark, d):
    """Power at the first three frequencies of each source's record; none where the record is too short to have them."""
    w = _w(spark, d)
    whole = w.groupBy("sid").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    turn = lambda k: 2 * np.pi * k * F.col("i") / F.col("n")
    v = F.col("v") - F.col("mean")
    sums = [f(v * g(turn(k))) for k in (1, 2, 3) for f, g in ((F.sum, F.cos), (F.sum, F.sin))]
    # the sums are added up in parts before the shuffle, so a source's record never lies in one task
    rows = w.join(whole, "sid").groupBy("sid", "n").agg(*[x.alias(f"x{j}") for j, x in enumerate(sums)])
    power = lambda k: F.when(F.col("n") >= 2 * k, (F.col(f"x{2 * k - 2}") ** 2 + F.col(f"x{2 * k - 1}") ** 2) * 0.25)
    return rows.select("sid", *(r(power(k), 3).alias(f"p{k}") for k in (1, 2, 3)))


@query
def sig_response_spectrum(spark, d):
    """Peaks of oscillators of three periods under each source's record."""
    found = recursive.response_spectrum(_w(spark, d), 0.01, [0.1, 0.5, 1.0])
    return found.select("sid", "period", *(r(F.col(c), 5).alias(c) for c in ("sd", "sv", "sa", "psv", "psa")))


@query
def sig_causal_filter(spark, d):
    """Each source's record through a causal low-pass filter of second order."""
    found = recursive.filtered(_w(spark, d), recursive.butterworth(0.01, lowpass=10.0, order=2))
    return found.select("sid", "k", r(F.col("y")).alias("y"))


@query
def sig_bandpass(spark, d):
    def kernel(x, delta):
        y = records.bandpass(x, delta, 2.0, 20.0)
        return {"rms": float(np.sqrt((y**2).mean())), "envelope": float(records.envelope(y).max())}

    return records.apply(records.from_samples(_w(spark, d), 0.01), kernel, rms="double", envelope="double")


@query
def site_sh_transfer(spark, d):
    """Amplification of each profile at three frequencies."""
    freq = np.array([0.5, 1.0, 5.0])
    one = lambda name: F.transform("layers", lambda x: x[name])
    stacked = views.profiles(spark, d).select(F.col("site").alias("sid"), F.lit(0.0).alias("delta"), F.concat(*map(one, ("hl", "vs", "dn", "qs"))).alias("data"))

    def kernel(x, delta):
        hl, vs, dn, qs = x.reshape(4, -1)
        return {"amplitude": np.abs(records.sh_transfer(freq, hl, vs, dn, qs)).tolist()}

    return records.apply(stacked, kernel, amplitude="array<double>").drop("delta")


def _layers(spark, d):
    """Profiles in km and km/s."""
    part = lambda x: F.struct((x["hl"] / 1000).alias("hl"), (x["vs"] / 1000).alias("vs"), (x["dn"] / 1000).alias("dn"), x["qs"].alias("qs"))
    return views.profiles(spark, d).select("site", F.transform("layers", part).alias("layers"))


@query
def site_dispersion(spark, d):
    """Phase and group velocities of the first two modes of Rayleigh and Love waves."""
    found = layered.dispersion(_layers(spark, d), [0.1, 0.3, 1.0], modes=2)
    return found.select("site", "wave", "mode", "period", r(F.col("phase")).alias("phase"), r(F.col("grp"), 4).alias("grp"))


@query
def site_kernels(spark, d):
    """The layer of each profile whose shear velocity the fundamental Rayleigh mode follows most, by period."""
    slopes = layered.sensitivity(_layers(spark, d), [0.1, 0.5], waves=["rayleigh"]).where("parameter = 'vs' and slope is not null")
    most = F.max(F.struct(F.abs("slope").alias("size"), F.col("layer"), F.col("slope")))
    return slopes.groupBy("site", "period").agg(most.alias("m"), F.sum("slope").alias("total")).select("site", "period", "m.layer", r(F.col("m.slope"), 4).alias("slope"), r(F.col("total"), 4).alias("total"))


@query
def site_incident_waves(spark, d):
    """Motion at the surface and at half the first layer for P, SV and SH waves from below."""
    out = None
    for wave, angle, depth in (("p", 0.3, 0.0), ("sv", 0.3, 0.0), ("sh", 0.0, 0.0), ("sh", 0.0, 0.005)):
        one = layered.response(_layers(spark, d), [1.0, 5.0], wave, angle, depth).select("site", F.lit(wave).alias("wave"), F.lit(depth).alias("depth"), "freq", r(F.col("horizontal"), 5).alias("horizontal"), r(F.col("vertical"), 5).alias("vertical"))
        out = one if out is None else out.union(one)
    return out


# streams


def _stream(spark, d):
    schema = views.table(spark, d, "events").schema
    return streams.source(spark, f"{d}/events.parquet", schema).select(F.col("user_id").alias("sid"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))


def _folder(spark) -> str:
    """The folder that all executors share; where none is set, a temporary one if Spark runs in this process alone."""
    master, found = spark.sparkContext.master, spark.conf.get("spark.checkpoint.dir", None)
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="lithoscope-")


@query
def stream_tumbling(spark, d):
    out = streams.run_to_end(streams.windowed(_stream(spark, d), "1 hour"), "complete", _folder(spark))
    return out.select(F.col("begin").cast("timestamp_ntz").alias("begin"), "sid", "n", r(F.col("total"), 4).alias("total"))


@query
def stream_sliding(spark, d):
    out = streams.run_to_end(streams.windowed(_stream(spark, d), "2 hours", "1 hour"), "complete", _folder(spark))
    return out.select(F.col("begin").cast("timestamp_ntz").alias("begin"), "sid", "n", r(F.col("total"), 4).alias("total"))


@query
def stream_segments(spark, d):
    out = streams.run_to_end(streams.merged_segments(_stream(spark, d), "30 minutes"), "complete", _folder(spark))
    return out.select(F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("end").cast("timestamp_ntz").alias("end"), "sid", "n")


@query
def stream_ring_buffer(spark, d):
    out = streams.run_to_end(streams.last_values(_stream(spark, d), 5), "update", _folder(spark))
    return out.select("sid", F.size("buffer").cast("long").alias("n"), r(F.element_at("buffer", -1)).alias("last"), r(F.element_at("buffer", 1)).alias("first"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FOUND)
