"""Exposure: assets from flat records, and what they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(records: DataFrame, key: str) -> DataFrame:
    """Records (lon, lat, taxonomy, number, seq and a key) as assets: asset_id, lon, lat, aggregated, typologies.

    The place is that of the first record that has one; an asset is aggregated
    if it has several records or one for several units; blank keys are dropped.
    """
    rows = records.where(F.trim(F.col(key).cast("string")) != "")
    first = lambda c: F.min_by(c, F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.col("seq")))
    kinds = F.array_sort(F.collect_list(F.struct("seq", "taxonomy", "number")))
    return rows.groupBy(F.col(key).alias("asset_id")).agg(
        first("lon").alias("lon"),
        first("lat").alias("lat"),
        ((F.count("*") > 1) | (F.max("number") > 1)).alias("aggregated"),
        F.transform(kinds, lambda k: F.struct(k["taxonomy"].alias("taxonomy"), k["number"].alias("n"))).alias("typologies"),
    )


def taxonomies(typologies: DataFrame) -> DataFrame:
    """Distinct building types that are not blank."""
    return typologies.where(F.trim("taxonomy") != "").select("taxonomy").distinct()


def branches(typologies: DataFrame, taxonomy_map: DataFrame) -> DataFrame:
    """asset_id, taxonomy, model_id, n: units by branch of the tree, rounded down; none that has no unit."""
    n = F.floor(F.col("n") * F.col("weight") + 1e-9)
    return typologies.join(taxonomy_map, "taxonomy").select("asset_id", "taxonomy", "model_id", n.alias("n")).where("n > 0")
