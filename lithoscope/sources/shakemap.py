"""Grids of ground motion (``grid.xml``, ``uncertainty.xml``) and their event data (``info.json``).

A grid is read by lines, so that a file is as many tasks as it has blocks: lines
of numbers are nodes, lines that declare a field name a column.  Fields meet nodes
in an equi-join by file.

Defined results: a line with other than one number a field is no node; a field
named twice is its last column; ``nan`` is null; a file without fields has no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scattered import scattered_values

_FIELD = r"<grid_field\s[^>]*>"
_NUMBERS = r"^[-+.0-9eEnNaA\s]+$"


def read_grid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """map_id (the file's folder), lon, lat, values (map of field to number): a row for each node."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract_all("value", F.lit(_FIELD), F.lit(0)).alias("tags"), F.trim(F.regexp_replace("value", "<[^>]*>", " ")).alias("text"))
    attribute = lambda tag, name: F.regexp_extract(tag, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    tags = lines.select("file", F.explode("tags").alias("tag")).select("file", attribute("tag", "index").try_cast("int").alias("at"), attribute("tag", "name").alias("name"))
    fields = tags.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    nodes = lines.where(F.col("text").rlike(_NUMBERS)).select("file", F.transform(F.split("text", r"\s+"), lambda x: F.nullif(x.try_cast("double"), F.lit(float("nan")))).alias("numbers"))
    met = nodes.join(fields, "file").where(F.size("numbers") == F.size("names"))
    # of a name that comes twice the last column counts
    last = F.filter(F.arrays_zip(F.col("names").alias("name"), F.col("numbers").alias("value")), lambda x, i: ~F.array_contains(F.slice("names", i + 2, F.size("names")), x["name"]))
    values = F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], x["value"])))
    folder = F.regexp_extract("file", r"([^/]+)/[^/]*$", 1)
    found = met.select(folder.alias("map_id"), values.alias("values"))
    return found.select("map_id", F.col("values")["LON"].alias("lon"), F.col("values")["LAT"].alias("lat"), F.map_filter("values", lambda k, v: ~k.isin("LON", "LAT")).alias("values"))


def read_info(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """map_id (the folder), event_id, magnitude, lon, lat, depth, origin_time, units (map of measure to unit)."""
    about = "event_id string, magnitude string, longitude string, latitude string, depth string, origin_time string"
    event = "event_information struct<" + about.replace(" string", ":string").replace(", ", ",") + ">"
    schema = f"input struct<{event.replace(' struct', ':struct')}>, output struct<ground_motions:map<string,struct<units:string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1).alias("map_id"), F.col("input.event_information").alias("e"), F.col("output.ground_motions").alias("g"))
    number = lambda c: F.col(f"e.{c}").try_cast("double")
    return raw.select("map_id", "e.event_id", number("magnitude").alias("magnitude"), number("longitude").alias("lon"), number("latitude").alias("lat"), number("depth").alias("depth"), "e.origin_time", F.transform_values("g", lambda k, v: v["units"]).alias("units"))


def with_uncertainty(grid: DataFrame, uncertainty: DataFrame) -> DataFrame:
    """Nodes with the fields of both grids, by map and place; fields of the second one win."""
    right = uncertainty.select("map_id", "lon", "lat", F.col("values").alias("more"))
    both = grid.join(right, ["map_id", "lon", "lat"], "left")
    more = F.coalesce("more", F.create_map().cast("map<string,double>"))
    return both.select("map_id", "lon", "lat", F.map_concat(F.map_filter("values", lambda k, v: ~F.map_contains_key(more, k)), more).alias("values"))


def values_at(grid: DataFrame, sites: DataFrame, measures: list[str], by_map: bool = False, fill: float | None = None) -> DataFrame:
    """``sites`` (lon, lat, ...) with a column for each measure, between the grid's nodes; ``fill`` where there is none.

    With ``by_map``, sites have a map_id of their own and take values from that map.
    """
    nodes = grid.select(*(["map_id"] if by_map else []), "lon", "lat", *[F.col("values")[m].alias(m) for m in measures])
    found = scattered_values(nodes, sites, measures, by=["map_id"] if by_map else [])
    return found if fill is None else found.fillna(fill, subset=measures)


def motion(grid: DataFrame, assets: DataFrame, measure: str = "PGA", unit: float = 0.01) -> DataFrame:
    """``assets`` with median (``unit`` a measured one: g of percent) and sigma (of the natural log; 0 where the map has none), as the scenario takes them."""
    found = values_at(grid, assets, [measure, f"STD{measure}"])
    name = lambda c: F.col(f"`{c}`")
    return found.select(*assets.columns, (name(measure) * unit).alias("median"), F.coalesce(name(f"STD{measure}"), F.lit(0.0)).alias("sigma"))


def site_columns(sites: DataFrame) -> DataFrame:
    """id, lon, lat of a table of sites whose columns go by any of their usual names."""
    usual = {"id": ("id", "site_id", "name"), "lon": ("longitude", "lon"), "lat": ("latitude", "lat")}
    by = {c.lower(): c for c in sites.columns}

    def pick(name: str) -> Column:
        for other in usual[name]:
            if other in by:
                return F.col(f"`{by[other]}`").alias(name)
        raise ValueError(f"no column for {name}: expected one of {', '.join(usual[name])}")

    return sites.select(pick("id"), pick("lon").cast("double"), pick("lat").cast("double"))


def write_values(values: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """GeoJSON, a feature on each line: a point of lon, lat with all other columns as its properties."""
    rest = [F.col(f"`{c}`") for c in values.columns if c not in ("lon", "lat")]
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    values.select(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties")).write.mode(mode).json(path)
