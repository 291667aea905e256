"""The library's frames made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions from order lines: event_id, idx, size, type, code, prime."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        F.row_number().over(order).alias("idx"),
        (F.col("l_quantity") / 10).alias("size"),
        F.col("l_returnflag").alias("type"),
        F.col("l_linestatus").alias("code"),
        (F.col("l_linenumber") == 1).alias("prime"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One solution for each order: event_id, idx, lon, lat, depth, ts, prime."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.lit(1).alias("idx"),
        (12 + F.col("o_custkey") % 400 / 100).alias("lon"),
        (45 + F.col("o_orderkey") % 300 / 100).alias("lat"),
        (F.col("o_orderkey") % 30).cast("double").alias("depth"),
        F.col("o_orderdate").alias("ts"),
        F.lit(True).alias("prime"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.catalogue import nested

    mags, locs = nested(magnitudes(spark, sf_dir), "magnitudes"), nested(locations(spark, sf_dir), "locations")
    return mags.join(locs, "event_id").withColumn("seq", F.col("event_id"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as assets: asset_id, lon, lat, elevation."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("asset_id"), (12 + F.col("c_custkey") % 400 / 100).alias("lon"), (45 + F.col("c_custkey") % 300 / 100).alias("lat"), F.lit(0.0).alias("elevation")
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations all over the map: lon, lat, two measured values (b is missing at every seventh)."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((12 + key * 157 % 400 / 100).alias("lon"), (45 + key * 211 % 300 / 100).alias("lat"), F.col("s_acctbal").alias("a"), F.when(key % 7 != 0, key.cast("double")).alias("b"))


def typologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each building type (part brand) an asset holds: asset_id, taxonomy, n."""
    lines, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = lines.select("l_orderkey", "l_partkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("o_custkey").alias("asset_id"), F.col("p_brand").alias("taxonomy")).agg(F.sum("l_quantity").alias("n"))


def taxonomy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weighted models for each brand but the last of each maker."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().where("p_brand not like '%5'")
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    branch = F.explode(F.array(F.lit(0), F.lit(1)))
    return brands.select(F.col("p_brand").alias("taxonomy"), number.alias("k"), branch.alias("j")).select("taxonomy", ((F.col("k") + F.col("j")) % 5).alias("model_id"), F.when(F.col("j") == 0, 0.7).otherwise(0.3).alias("weight"))


def fragility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five models of five levels, one model for each region."""
    levels = F.explode(F.sequence(F.lit(1), F.lit(5)))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("model_id"), levels.alias("level_ord")).select(
        "model_id", "level_ord", F.concat(F.lit("D"), F.col("level_ord")).alias("level"), (0.05 * (F.col("level_ord") + F.col("model_id") / 4)).alias("theta"), (0.5 + 0.05 * F.col("model_id")).alias("beta")
    )


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of one source for each user: sid, i (from 0), t (seconds), v."""
    order = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sid"), (F.row_number().over(order) - 1).cast("long").alias("i"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("value") - 245).alias("v")
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soil profiles from all parts of each brand, six layers each (the last one what is left): site (brand/number), layers (hl, vs, qs, dn)."""
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = table(spark, sf_dir, "part").withColumn("n", F.row_number().over(order) - 1).withColumn("k", F.col("n") % 6 + 1)
    layer = F.struct("k", F.col("p_size").cast("double").alias("hl"), (100 + F.col("p_retailprice") / 4).alias("vs"), (10.0 + F.col("k")).alias("qs"), (1800.0 + 50 * F.col("k")).alias("dn"))
    cut = rows.groupBy("p_brand", F.expr("n div 6").alias("number")).agg(F.array_sort(F.collect_list(layer)).alias("layers"))
    return cut.select(F.concat("p_brand", F.lit("/"), "number").alias("site"), "layers")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as channels of two stages, a pole and a filter of two points: as ``read_resp`` gives."""
    key = F.col("s_suppkey")
    root = F.array(F.struct((-1.0 - key % 50 / 10).alias("Real"), (key % 7 / 2).alias("Imaginary")))
    none = F.lit(None)
    paz = F.struct(F.lit(1).alias("stage"), (100.0 + F.col("s_nationkey")).alias("gain"), F.lit(2.0).alias("scale"), root.alias("poles"), F.lit("paz").alias("kind"), none.cast("array<double>").alias("numerators"), none.cast("double").alias("rate"))
    fir = F.struct(F.lit(2).alias("stage"), F.lit(1.0).alias("gain"), none.cast("double").alias("scale"), none.cast(root_type := "array<struct<Real:double,Imaginary:double>>").alias("poles"), F.lit("fir").alias("kind"), F.array(F.lit(0.75), F.lit(0.25)).alias("numerators"), (20.0 + key % 5).alias("rate"))
    rows = table(spark, sf_dir, "supplier").select(key.alias("sid"), F.explode(F.array(paz, fir)).alias("x")).select("sid", "x.*")
    return rows.withColumns({"start": none.cast("timestamp_ntz"), "end": none.cast("timestamp_ntz"), "zeros": none.cast(root_type), "denominators": none.cast("array<double>")})
