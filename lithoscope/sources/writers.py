"""Catalogues, exposure, fragility, taxonomies, geometries, responses and records as files that this package reads again.

A line of a JSON file is a whole document of one event, asset, model, mapping or
geometry, so that many tasks write and read it; readers take ``lines=True``.
``mode`` is Spark's: an existing folder is an error unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .waveforms import DYNA_HEADER


def _write_lines(documents: DataFrame, document: Column, path: str, mode: str) -> None:
    documents.select(document.alias("value")).write.mode(mode).text(path)


def _solutions(df: DataFrame, name: str) -> DataFrame:
    """event_id and its solutions in order of idx."""
    rest = [c for c in df.columns if c not in ("event_id", "idx")]
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.struct(*rest).alias("s"))))
    return df.groupBy("event_id").agg(F.transform(ordered, lambda x: x["s"]).alias(name))


def write_catalogue(magnitudes: DataFrame, locations: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Events with their magnitudes and locations; an event that has none of one kind has no list of it."""
    events = _solutions(magnitudes, "Magnitude").join(_solutions(locations, "Location"), "event_id", "full")
    event = F.struct(F.col("event_id").alias("Id"), "Magnitude", "Location")
    _write_lines(events, F.to_json(F.struct(F.struct(F.array(event).alias("Event")).alias("EqDatabase"))), path, mode)


def write_exposure(assets: DataFrame, typologies: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Assets (asset_id, lon, lat, elevation, aggregated, vs30) with their typologies (asset_id, taxonomy, n, ...) in order of taxonomy."""
    given = [c for c in ("usage", "stories", "replacement_cost", "occupants") if c in typologies.columns]
    kinds = typologies.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("taxonomy", F.col("n").alias("count"), *given))).alias("typologies"))
    asset = F.struct(
        F.col("asset_id").alias("id"),
        "aggregated",
        F.struct(F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), "elevation").alias("reference_location"),
        F.struct("vs30").alias("reference_geology"),
        "typologies",
    )
    _write_lines(assets.join(kinds, "asset_id", "left"), F.to_json(F.struct(F.array(asset).alias("assets"))), path, mode)


def write_fragility(levels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Models from a row for each level (model_id, imt, model_type, level_ord, level, theta, beta, points, log_im)."""
    ordered = F.array_sort(F.collect_list(F.struct("level_ord", "level", "theta", "beta", "points", "log_im")))
    models = levels.groupBy("model_id", "imt", "model_type").agg(ordered.alias("levels"))
    entries = lambda kept, value: F.map_from_entries(F.transform(F.filter("levels", kept), lambda x: F.struct(x["level"], value(x))))
    table = lambda x: F.struct(x["points"]["im"].alias("im"), x["points"]["poe"].alias("poe"), x["log_im"].alias("log_im"))
    model = F.struct(
        F.col("model_id").alias("id"),
        "imt",
        "model_type",
        F.struct(F.transform("levels", lambda x: x["level"]).alias("levels")).alias("damage_scale"),
        entries(lambda x: x["theta"].isNotNull(), lambda x: F.struct(x["theta"].alias("theta"), x["beta"].alias("beta"))).alias("parameters"),
        entries(lambda x: x["points"].isNotNull(), table).alias("tables"),
    )
    _write_lines(models, F.to_json(F.struct(F.array(model).alias("models"))), path, mode)


def write_taxonomy(refs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Mappings from taxonomy, model_id, weight; models in order of their ids."""
    grouped = refs.groupBy("taxonomy").agg(F.array_sort(F.collect_list(F.struct(F.col("model_id").alias("id"), "weight"))).alias("fragility_models"))
    _write_lines(grouped, F.to_json(F.struct(F.create_map("taxonomy", F.struct("fragility_models")).alias("mappings"))), path, mode)


def write_geojson(shapes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A feature a line from id, kind, parts (rings of lon, lat); rings of polygons are closed; a shape without points has no geometry, and other kinds raise."""
    pair = lambda p: F.array(p["lon"], p["lat"])
    places = lambda ring: F.transform(ring, pair)
    closed = lambda ring: places(F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1))))
    first, kind = F.col("parts")[0], F.col("kind")
    coordinates = (
        F.when(kind == "Point", F.to_json(pair(first[0])))
        .when(kind == "MultiPoint", F.to_json(places(first)))
        .when(kind == "Polygon", F.to_json(F.array(closed(first))))
        .when(kind == "MultiPolygon", F.to_json(F.transform("parts", lambda ring: F.array(closed(ring)))))
        .otherwise(F.raise_error(F.concat(F.lit("no geometry of kind "), F.coalesce(kind, F.lit("null")))).cast("string"))
    )
    named = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id").cast("string").alias("id")), {"ignoreNullFields": "false"})
    whole = (F.size("parts") > 0) & F.forall("parts", lambda ring: F.size(ring) > 0)
    geometry = F.when(F.coalesce(whole, F.lit(False)), F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))).otherwise("null")
    feature = F.concat(F.expr("substring(named, 1, length(named) - 1)"), F.lit(',"geometry":'), geometry, F.lit("}"))
    _write_lines(shapes.withColumn("named", named), feature, path, mode)


RESPONSE = "sid string, start timestamp_ntz, end timestamp_ntz, stage int, gain double, scale double, poles array<struct<Real:double,Imaginary:double>>, zeros array<struct<Real:double,Imaginary:double>>"


def write_responses(stages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A line for each stage; complex numbers are their two parts."""
    stages.select(*(f.split()[0] for f in RESPONSE.split(", "))).write.mode(mode).json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE).json(path)


def write_table(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    """Delimited text, nothing for null: completeness tables, layers, site values, meshes."""
    df.write.mode(mode).csv(path, sep=delimiter, header=header, nullValue="", emptyValue="")


def write_sorted(df: DataFrame, keys: list[str], path: str, mode: str = "errorifexists") -> None:
    """JSON lines in order of ``keys``, over all files of the folder: damage by asset and its summaries."""
    df.sort(*keys).write.mode(mode).json(path)


def write_dyna(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """sid (NET.STA.LOC.STREAM), t0 (text of the header), delta, data: a file for each record, in a folder of its sid and t0."""
    code = F.split("sid", r"\.")
    known = (("NETWORK", code[0]), ("STATION_CODE", code[1]), ("LOCATION", code[2]), ("STREAM", code[3]), ("SAMPLING_INTERVAL_S", F.col("delta").cast("string")), ("DATE_TIME_FIRST_SAMPLE_YYYYMMDD_HHMMSS", F.col("t0")), ("NDATA", F.size("data").cast("string")))
    head = [F.concat(F.lit(f"{key}: "), F.coalesce(value, F.lit(""))) for key, value in known]
    blank = F.array_repeat(F.lit("USER:"), DYNA_HEADER - len(head))
    text = F.array_join(F.concat(F.array(*head), blank, F.transform("data", lambda x: x.cast("string"))), "\n")
    records.select("sid", "t0", text.alias("value")).write.mode(mode).partitionBy("sid", "t0").text(path)


NRML_ASSET = """_id string, _number double, _taxonomy string, location struct<_lon:double,_lat:double>,
  costs struct<cost:array<struct<_type:string,_value:double>>>, occupancies struct<occupancy:array<struct<_period:string,_occupants:double>>>"""


def read_nrml_exposure(spark: SparkSession, path: str) -> DataFrame:
    """asset_id, lon, lat, taxonomy, number, costs and occupants (maps by type and period; the last of a repeated one) of NRML exposure models."""
    rows = spark.read.format("xml").option("rowTag", "asset").schema(NRML_ASSET).load(path)

    def by(items: str, key: str, value: str) -> Column:
        last = F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y[key] == x[key]))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x[key], x[value])))

    flat = rows.withColumns({"cost": F.col("costs.cost"), "occupancy": F.col("occupancies.occupancy")})
    return flat.select(F.col("_id").alias("asset_id"), F.col("location._lon").alias("lon"), F.col("location._lat").alias("lat"), F.col("_taxonomy").alias("taxonomy"), F.col("_number").alias("number"), by("cost", "_type", "_value").alias("costs"), by("occupancy", "_period", "_occupants").alias("occupants"))
