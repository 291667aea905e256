"""Site response parameters as column expressions.

A profile is an array of structs, one for each layer from the top; the last layer
goes on without end, whatever its thickness.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth_average(layers: Column, value: Callable[[Column], Column], depth: Column) -> Column:
    """Mean of ``value(layer)`` down to ``depth``, weighted by thickness ``hl``."""
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"))

    def step(s: Column, layer: Column, last: Column) -> Column:
        bottom = F.when(last, depth).otherwise(F.least(s["top"] + layer["hl"], depth))
        return F.struct(bottom.alias("top"), (s["sum"] + (bottom - s["top"]) * value(layer)).alias("sum"))

    marked = F.transform(layers, lambda layer, i: F.struct(layer.alias("l"), (i == F.size(layers) - 1).alias("last")))
    return F.aggregate(marked, start, lambda s, m: step(s, m["l"], m["last"]))["sum"] / depth


def travel_time_velocity(layers: Column, depth: Column, speed: str = "vs") -> Column:
    """Depth over vertical travel time: Vs30 with ``vs`` and 30 m."""
    return 1 / depth_average(layers, lambda x: 1 / x[speed], depth)


def vs30(layers: Column) -> Column:
    return travel_time_velocity(layers, F.lit(30.0))


def site_kappa(layers: Column, depth: Column | None = None) -> Column:
    """Attenuation down to a depth, by default that of the half-space; none where that lies at the surface."""
    if depth is None:
        above = F.slice(layers, F.lit(1), F.size(layers) - 1)
        depth = F.aggregate(above, F.lit(0.0), lambda s, x: s + x["hl"])
    return F.when(depth == 0, 0.0).otherwise(depth * depth_average(layers, lambda x: 1 / (x["vs"] * x["qs"]), depth))


#: Lower bounds of Vs30 by class, inclusive.
SOIL_CLASSES = {"EC8": (("A", 800.0), ("B", 360.0), ("C", 180.0), ("D", 0.0)), "NEHRP": (("A", 1500.0), ("B", 760.0), ("C", 360.0), ("D", 180.0), ("E", 0.0))}


def soil_class(velocity: Column, code: str = "EC8") -> Column:
    out = F.lit(None).cast("string")
    for name, least in reversed(SOIL_CLASSES[code]):
        out = F.when(velocity >= least, name).otherwise(out)
    return out


def impedance_amplification(top_vs: Column, top_dn: Column, ref_vs: Column, ref_dn: Column, incidence_deg: float = 0.0) -> Column:
    """Square root of the impedance contrast, with Snell's law for a wave that comes in at an angle."""
    sine = math.sin(math.radians(incidence_deg))
    refracted = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), top_vs / ref_vs * sine)))
    return F.sqrt(ref_dn * ref_vs * math.cos(math.radians(incidence_deg)) / (top_dn * top_vs * F.cos(refracted)))


def attenuation_decay(frequency: Column, kappa: Column) -> Column:
    return F.exp(-math.pi * kappa * frequency)


def quarter_wavelength_depth(layers: Column, frequency: Column) -> Column:
    """Depth whose travel time is a quarter of the period; travel time grows with depth, so layers are walked once."""
    start = F.struct((1 / (4 * frequency)).alias("left"), F.lit(0.0).alias("depth"))

    def step(s: Column, layer: Column, last: Column) -> Column:
        used = F.when(last, s["left"]).otherwise(F.least(s["left"], layer["hl"] / layer["vs"]))
        return F.struct((s["left"] - used).alias("left"), (s["depth"] + used * layer["vs"]).alias("depth"))

    marked = F.transform(layers, lambda layer, i: F.struct(layer.alias("l"), (i == F.size(layers) - 1).alias("last")))
    return F.aggregate(marked, start, lambda s, m: step(s, m["l"], m["last"]))["depth"]
