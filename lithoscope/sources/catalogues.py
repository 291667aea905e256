"""Catalogue files as solutions: events with locations and magnitudes in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NULLS = ("", "None", "none", "NaN", "nan")


def cast_value(column, kind: str):
    """Cast with the usual words for nothing as null; what cannot be cast is null."""
    return F.when(F.trim(column).isin(*NULLS), None).otherwise(F.trim(column)).try_cast(kind)


def read_table(spark: SparkSession, path: str, types: dict[str, str] | None = None, delimiter: str = ",", comment: str = "#", header: bool = True) -> DataFrame:
    """Delimited text; columns are text unless ``types`` says otherwise."""
    raw = spark.read.csv(path, sep=delimiter, comment=comment, header=header, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select(*(cast_value(F.col(c), (types or {}).get(c, "string")).alias(c) for c in raw.columns))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the number of each row, from 0; only the counts of partitions, one row each, meet in one task."""
    dealt = df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.join(counts, "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """One location and magnitude a row: event_id (or the row's number), lon, lat, depth, ts, size, type, code."""
    types = {"Id": "string", "Year": "int", "Month": "int", "Day": "int", "Hour": "int", "Minute": "int", "Second": "double", "Longitude": "double", "Latitude": "double", "Depth": "double", "MagSize": "double"}
    df = read_table(spark, path, types, delimiter)
    df = df if "Id" in df.columns else _numbered(df, "Id")
    part = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)
    ts = F.make_timestamp_ntz(part("Year", 1), part("Month", 1), part("Day", 1), part("Hour", 0), part("Minute", 0), part("Second", 0.0).cast("decimal(8,6)"))
    column = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return df.select(
        F.col("Id").cast("string").alias("event_id"), ts.alias("ts"), column("Longitude").alias("lon"), column("Latitude").alias("lat"), column("Depth").alias("depth"),
        column("MagSize").alias("size"), column("MagType").cast("string").alias("type"), column("MagCode").cast("string").alias("code"),
    )


def read_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Magnitudes and locations (event_id, idx, ...) of {EqDatabase: {Event: [{Id, Magnitude, Location}]}}; with ``lines`` each line is such a document."""
    events = spark.read.json(path, multiLine=not lines).select(F.explode("EqDatabase.Event").alias("e"))
    side = lambda name: events.select(F.col("e.Id").cast("string").alias("event_id"), F.posexplode(f"e.{name}").alias("idx", "s")).select("event_id", "idx", "s.*")
    return side("Magnitude"), side("Location")


def read_isf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Magnitudes and locations of IMS 1.0 bulletins, one file a partition's text.

    An event's lines follow its ``Event`` line; blocks are told by their header
    lines; ``(#PRIME)`` flags the origin before it and ``(#CENTROID)`` is not one.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"), F.col("_metadata.file_path").alias("file"))
    order = Window.partitionBy("file").orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    event = F.last(F.when(F.col("line").startswith("Event "), F.regexp_extract("line", r"^Event\s+(\S+)", 1)), ignorenulls=True).over(so_far)
    block = F.last(F.when(F.col("line").rlike(r"^\s+Date\s+Time"), "origin").when(F.col("line").startswith("Magnitude"), "magnitude").when(F.trim("line") == "", ""), ignorenulls=True).over(so_far)
    marked = lines.withColumn("event_id", event).withColumn("block", block).withColumn("next", F.lead("line").over(order))
    piece = lambda a, n: F.trim(F.substring("line", a, n))
    origins = marked.where("block = 'origin'").where(F.col("line").rlike(r"^\d{4}/\d{2}/\d{2}"))
    locations = origins.select(
        "event_id", F.row_number().over(Window.partitionBy("event_id").orderBy("n")).alias("idx"), F.try_to_timestamp(F.concat_ws(" ", piece(1, 10), piece(12, 11)), F.lit("yyyy/MM/dd HH:mm:ss.SS")).cast("timestamp_ntz").alias("ts"),
        piece(37, 8).try_cast("double").alias("lat"), piece(46, 9).try_cast("double").alias("lon"), F.regexp_replace(piece(72, 5), "f", "").try_cast("double").alias("depth"), piece(119, 9).alias("code"), F.coalesce(F.col("next").contains("#PRIME"), F.lit(False)).alias("prime"),
    )
    mags = marked.where("block = 'magnitude'").where(F.col("line").rlike(r"^[A-Za-z]+\S*\s+-?\d")).select(
        "event_id", F.row_number().over(Window.partitionBy("event_id").orderBy("n")).alias("idx"), piece(1, 5).alias("type"), piece(7, 4).try_cast("double").alias("size"), piece(12, 3).try_cast("double").alias("error"), piece(21, 9).alias("code"), F.lit(False).alias("prime"),
    )
    return mags, locations


QUAKEML = """_publicID string, preferredOriginID string, preferredMagnitudeID string,
  origin array<struct<_publicID:string,time:struct<value:string>,latitude:struct<value:double>,longitude:struct<value:double>,depth:struct<value:double>,creationInfo:struct<agencyID:string>>>,
  magnitude array<struct<_publicID:string,mag:struct<value:double,uncertainty:double>,type:string,creationInfo:struct<agencyID:string>>>"""


def read_quakeml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Magnitudes and locations; preferred ones are prime; depths in km; events without a whole origin are dropped."""
    events = spark.read.format("xml").option("rowTag", "event").schema(QUAKEML).load(path)
    event_id = F.regexp_extract("_publicID", r"(?:eventId=|.*/)([^/&]+)$", 1)
    whole = lambda o: o["time"]["value"].isNotNull() & o["latitude"]["value"].isNotNull() & o["longitude"]["value"].isNotNull()
    kept = events.withColumn("event_id", event_id).withColumn("origin", F.filter("origin", whole)).where(F.size("origin") > 0)
    locations = kept.select("event_id", "preferredOriginID", F.posexplode("origin").alias("idx", "o")).select(
        "event_id", "idx", F.try_to_timestamp("o.time.value").cast("timestamp_ntz").alias("ts"), F.col("o.longitude.value").alias("lon"), F.col("o.latitude.value").alias("lat"), (F.col("o.depth.value") / 1000).alias("depth"), F.col("o.creationInfo.agencyID").alias("code"), (F.col("o._publicID") == F.col("preferredOriginID")).alias("prime")
    )
    mags = kept.select("event_id", "preferredMagnitudeID", F.posexplode("magnitude").alias("idx", "m")).select(
        "event_id", "idx", F.col("m.mag.value").alias("size"), F.col("m.mag.uncertainty").alias("error"), F.col("m.type").alias("type"), F.col("m.creationInfo.agencyID").alias("code"), (F.col("m._publicID") == F.col("preferredMagnitudeID")).alias("prime")
    )
    return mags, locations
