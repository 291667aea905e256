"""Meshes of points made in parallel, and values at points from regular grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

GOLDEN = math.pi * (3 - math.sqrt(5))


def fibonacci_global(spark: SparkSession, spacing_km: float) -> DataFrame:
    """id, lon, lat: points spread evenly over the sphere by the golden angle."""
    n = round(4 * math.pi * (geo.EARTH_RADIUS_M / 1000) ** 2 / spacing_km**2)
    z = 1 - (2 * F.col("id") + 1) / n
    return spark.range(n).select("id", geo.normalize_longitude(F.degrees(F.col("id") * GOLDEN)).alias("lon"), F.degrees(F.asin(z)).alias("lat"))


def fibonacci_cap(spark: SparkSession, lon: float, lat: float, most_km: float, spacing_km: float) -> DataFrame:
    """id, lon, lat: the same within a distance of a centre."""
    r = geo.EARTH_RADIUS_M / 1000
    share = (1 - math.cos(most_km / r)) / 2
    n = max(1, round(4 * math.pi * r**2 * share / spacing_km**2))
    z = 1 - 2 * share * (F.col("id") + 0.5) / n
    side, angle = F.sqrt(1 - z * z), F.col("id") * GOLDEN
    x, y = side * F.cos(angle), side * F.sin(angle)
    # turn the pole to the centre
    tilt, spin = math.radians(90 - lat), math.radians(lon)
    u, w = x * math.cos(tilt) + z * math.sin(tilt), z * math.cos(tilt) - x * math.sin(tilt)
    px, py = u * math.cos(spin) - y * math.sin(spin), u * math.sin(spin) + y * math.cos(spin)
    return spark.range(n).select("id", F.degrees(F.atan2(py, px)).alias("lon"), F.degrees(F.asin(w)).alias("lat"))


def cartesian(spark: SparkSession, lon: tuple[float, float], lat: tuple[float, float], step_lon: float, step_lat: float) -> DataFrame:
    """id, lon, lat: a regular grid, both ends included."""
    nx, ny = (int(math.floor((b - a) / s + 1e-12)) + 1 for (a, b), s in ((lon, step_lon), (lat, step_lat)))
    return spark.range(nx * ny).select("id", (F.col("id") % nx * step_lon + lon[0]).alias("lon"), (F.floor(F.col("id") / nx) * step_lat + lat[0]).alias("lat"))


def sinusoidal(spark: SparkSession, spacing_km: float, lat: tuple[float, float] = (-90.0, 90.0)) -> DataFrame:
    """lon, lat: rows at equal distances, points of a row too."""
    step = math.degrees(spacing_km * 1000 / geo.EARTH_RADIUS_M)
    rows = spark.range(int((lat[1] - lat[0]) / step) + 1).select((F.col("id") * step + lat[0]).alias("lat"))
    half = F.floor(180 * F.cos(F.radians("lat")) / step)
    return rows.select(F.explode(F.sequence(-half, half)).alias("k"), "lat").select((F.col("k") * step / F.cos(F.radians("lat"))).alias("lon"), "lat").where("abs(lon) < 180")


def clipped(mesh: DataFrame, parts: Column) -> DataFrame:
    """Points inside a polygon."""
    return mesh.where(geo.in_polygon(parts, F.col("lon"), F.col("lat")))


def cell(column: str, origin: float, step: float) -> Column:
    return F.floor((F.col(column) - origin) / step + 1e-9)


def grid_values(grid: DataFrame, points: DataFrame, origin: tuple[float, float], step: float) -> DataFrame:
    """``points`` (lon, lat, ...) with ``value`` between the four corners of their cell; null where one is missing.

    ``grid``: lon, lat, value on a regular grid.  An equi-join on the cell, in
    which every grid point stands for the corners of four cells.
    """
    x, y = cell("lon", origin[0], step), cell("lat", origin[1], step)
    ends = F.array(F.lit(0), F.lit(1))
    corners = grid.select(x.alias("gx"), y.alias("gy"), "value").select("*", F.explode(ends).alias("dx"), ends.alias("d")).select("*", F.explode("d").alias("dy"))
    cells = corners.select((F.col("gx") - F.col("dx")).alias("x"), (F.col("gy") - F.col("dy")).alias("y"), "dx", "dy", "value").groupBy("x", "y").agg(
        *(F.max(F.when((F.col("dx") == a) & (F.col("dy") == b), F.col("value"))).alias(f"v{a}{b}") for a in (0, 1) for b in (0, 1))
    )
    u, v = (F.col("lon") - origin[0]) / step - x, (F.col("lat") - origin[1]) / step - y
    joined = points.withColumn("x", x).withColumn("y", y).withColumn("u", u).withColumn("v", v).join(cells, ["x", "y"], "left")
    value = (1 - F.col("u")) * (1 - F.col("v")) * F.col("v00") + F.col("u") * (1 - F.col("v")) * F.col("v10") + (1 - F.col("u")) * F.col("v") * F.col("v01") + F.col("u") * F.col("v") * F.col("v11")
    return joined.withColumn("value", value).select(*points.columns, "value")
