"""Ground motion of registered models for many intensity measures at once.

A model is registered under a name and aliases; its coefficients are a frame with
a row for each set and measure, so all measures asked for are one join and one
plan.  The table is as long as its file; whether it is broadcast is left to
Spark's size check.

Defined results: a measure that the model's set lacks has no rows, or raises an
error with ``strict``; a null magnitude, place or, where the model uses it, vs30
gives a null mean; a null ``measured`` counts as inferred; unknown names raise
KeyError and names taken twice ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import ground_motion as gm

#: mag, km, site (a column by name), imt and coefficients to the natural log of the median and its deviation
Form = Callable[[Column, Column, Callable[[str], Column], Column, Mapping[str, Column]], tuple[Column, Column]]


@dataclass(frozen=True)
class Model:
    """``keys`` are the coefficients that the form reads, ``uses`` the site columns; velocity is the vs30 of its reference rock."""

    name: str
    form: Form
    metric: str
    velocity: float
    keys: tuple[str, ...]
    uses: tuple[str, ...] = ()
    coefficient_set: str = "default"


_MODELS: dict[str, Model] = {}
_ALIASES: dict[str, str] = {}
METRICS = ("epicentral", "hypocentral", "joyner-boore")


def register(model: Model, aliases: Iterable[str] = ()) -> Model:
    """Make a model known; nothing is registered if one of its names is taken."""
    names = [model.name, *aliases]
    if model.metric not in METRICS:
        raise ValueError(f"{model.metric} is no distance: {', '.join(METRICS)}")
    for name in names:
        if not name.strip() or name in _MODELS or name in _ALIASES or names.count(name) > 1:
            raise ValueError(f"name of a model is blank or taken: {name!r}")
    _MODELS[model.name] = model
    _ALIASES.update(dict.fromkeys(names[1:], model.name))
    return model


def registered() -> list[str]:
    return sorted(_MODELS)


def resolve(name: str) -> Model:
    """A model by its name or an alias."""
    found = _MODELS.get(_ALIASES.get(name, name))
    if found is None:
        raise KeyError(f"{name!r} is no model: {', '.join(registered())}")
    return found


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """set, imt, c (coefficient by key), from JSON: ``coefficients`` by set, each with ``keys`` and, by measure, ``type``."""
    sets = spark.read.schema("coefficients map<string,struct<keys:array<string>,type:map<string,array<string>>>>").json(path, multiLine=True)
    rows = sets.select(F.explode("coefficients").alias("set", "s")).select("set", "s.keys", F.explode("s.type").alias("imt", "v"))
    return rows.select("set", "imt", F.map_from_arrays("keys", F.transform("v", lambda x: x.cast("double"))).alias("c"))


def coefficients(spark: SparkSession, table: Mapping[str, Mapping[str, Mapping[str, float]]]) -> DataFrame:
    """The same from a mapping: set, measure, key."""
    rows = [(s, imt, {k: float(v) for k, v in c.items()}) for s, measures in table.items() for imt, c in measures.items()]
    return spark.createDataFrame(rows, "set string, imt string, c map<string,double>")


def measures(table: DataFrame, model: str | Model) -> DataFrame:
    """imt: what a model's set of coefficients has."""
    return table.where(F.col("set") == _model(model).coefficient_set).select("imt").distinct()


def _model(model: str | Model) -> Model:
    return model if isinstance(model, Model) else resolve(model)


def distance(metric: str, lon: Column, lat: Column, e_lon: Column, e_lat: Column, depth: Column) -> Column:
    """Kilometres from a point source; it has no extent, so its Joyner-Boore distance is the epicentral one."""
    km = geo.great_circle(lon, lat, e_lon, e_lat) / 1000
    return F.sqrt(km * km + depth * depth) if metric == "hypocentral" else km


def ground_motion(sites: DataFrame, table: DataFrame, model: str | Model, event: Mapping[str, Column | float], imts: Iterable[str], strict: bool = False) -> DataFrame:
    """``sites`` (lon, lat and what the model uses) with imt, ln_mean and sigma: a row for each site and measure.

    ``event``: mag, lon, lat, depth as numbers or columns of ``sites``.
    Accelerations are in g, velocities in m/s.
    """
    m, imts = _model(model), list(dict.fromkeys(imts))
    missing = [c for c in m.uses if c not in sites.columns]
    if missing:
        raise ValueError(f"{m.name} needs {', '.join(missing)}")
    own = table.where((F.col("set") == m.coefficient_set) & F.col("imt").isin(imts)).select(F.col("imt").alias("_imt"), F.col("c").alias("_c"))
    at = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in event.items()}
    km = distance(m.metric, F.col("lon"), F.col("lat"), at["lon"], at["lat"], at.get("depth", F.lit(0.0)))
    rows = sites.withColumns({"_mag": at["mag"], "_km": km})
    asked = F.explode(F.array(*[F.lit(i) for i in imts]).cast("array<string>")).alias("_imt")
    rows = rows.select("*", asked).join(own, "_imt", "left" if strict else "inner")
    if strict:
        rows = rows.withColumn("_c", F.when(F.col("_c").isNull(), F.raise_error(F.concat(F.lit(f"{m.name} has no measure "), "_imt")).cast("map<string,double>")).otherwise(F.col("_c")))
    mean, sigma = m.form(F.col("_mag"), F.col("_km"), F.col, F.col("_imt"), {k: F.col("_c")[k] for k in m.keys})
    return rows.select(*[F.col(f"`{c}`") for c in sites.columns], F.col("_imt").alias("imt"), mean.alias("ln_mean"), sigma.alias("sigma"))


def _bragato_slejko(mag, km, site, imt, c):
    mean, sigma = gm.bragato_slejko_2005(mag, km, c)
    return mean - F.when(imt == "PGV", math.log(100.0)).otherwise(0.0), sigma


def _atkinson(mag, km, site, imt, c):
    mean, sigma = gm.atkinson_2015(mag, km, c, velocity=True)
    return mean - F.when(imt == "PGV", 0.0).otherwise(math.log(gm.GRAVITY)), sigma


def _kotha(ergodic: bool) -> Form:
    def form(mag, km, site, imt, c):
        measured = F.coalesce(site("measured"), F.lit(False))
        mean = gm.kotha_2020(mag, km, site("vs30"), site("depth"), measured, c)
        shift = F.when(imt.startswith("PGA") | imt.startswith("SA"), math.log(100.0 * gm.GRAVITY)).otherwise(0.0)
        return mean - shift, gm.kotha_2020_deviation(measured, c, ergodic)

    return form


_BS = ("a", "b", "c", "d", "e", "h", "s")
_KOTHA = ("e1", "b1", "b2", "b3", "c1", "c2", "c3", "d0_obs", "d1_obs", "d0_inf", "d1_inf", "tau_event_0", "tau_l2l", "phi_0", "phi_s2s_obs", "phi_s2s_inf")
register(Model("BragatoSlejko2005", _bragato_slejko, "epicentral", 800.0, _BS, coefficient_set="epicentral"), ["BS2005", "Bragato2005", "Bragato_Slejko_2005"])
register(Model("BragatoSlejko2005JB", _bragato_slejko, "joyner-boore", 800.0, _BS, coefficient_set="joyner-boore"))
register(Model("Atkinson2015", _atkinson, "hypocentral", 760.0, ("c0", "c1", "c2", "c3", "phi")))
register(Model("KothaEtAl2020ESHM20", _kotha(True), "joyner-boore", 800.0, _KOTHA, ("vs30", "depth", "measured")))
