"""Hazard statistics over catalogues."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_force(table: DataFrame, year: int | Column) -> DataFrame:
    """Completeness entries (magnitude, year_start, year_end, completeness) of a year, both ends included."""
    return table.where((F.col("year_start") <= year) & (F.col("year_end") >= year))


def at_magnitude(table: DataFrame, magnitude: float | Column) -> DataFrame:
    return table.where(F.col("magnitude") == magnitude)


def add_entries(table: DataFrame, entries: DataFrame) -> DataFrame:
    return table.unionByName(entries)


def update_entries(table: DataFrame, which: Column, **values) -> DataFrame:
    """New values for the entries for which ``which`` is true; if it is null, an entry stays as it is."""
    return table.select(*(F.when(which, F.lit(values[c]).cast(kind)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, kind in table.dtypes))


def remove_entries(table: DataFrame, which: Column) -> DataFrame:
    return table.where(~F.coalesce(which, F.lit(False)))


def by_magnitude(table: DataFrame) -> DataFrame:
    return table.orderBy("magnitude", "year_start", "year_end", "completeness")


def by_year(table: DataFrame) -> DataFrame:
    return table.orderBy("year_start", "magnitude", "year_end", "completeness")


def average_completeness(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.avg("completeness"), F.lit(0.0)).alias("completeness"))


def magnitude_histogram(events: DataFrame, bin_width: float, smallest: float) -> DataFrame:
    """m (middle of the bin), n: counted in each task before anything is shuffled."""
    k = F.floor((F.col("m") - smallest) / bin_width + 1e-9)
    return events.where(F.col("m") >= smallest).groupBy(k.alias("k")).agg(F.count("*").alias("n")).select((F.col("k") * bin_width + smallest + bin_width / 2).alias("m"), "n")


def aki_b_value(events: DataFrame, smallest: float, bin_width: float = 0.1) -> DataFrame:
    """Maximum-likelihood b-value (Aki, with Utsu's correction for bins) and its deviation."""
    excess = F.avg("m") - (smallest - bin_width / 2)
    return events.where(F.col("m") >= smallest).agg(F.count("*").alias("n"), (math.log10(math.e) / excess).alias("b")).withColumn("b_sigma", F.col("b") / F.sqrt("n"))


def weichert(bins: DataFrame, beta: float = 1.5, rounds: int = 50) -> dict:
    """Weichert's maximum-likelihood rates for unequal times of observation; ``bins``: m, n, years.

    Newton's method on the derivative; each round needs sums over the magnitude
    bins only, which are few, so they are fetched once.  Without events all values
    are null; those of one bin have a rate, but no slope.
    """
    rows = [(r.m, r.n, r.years) for r in bins.groupBy("m").agg(F.sum("n").alias("n"), F.max("years").alias("years")).orderBy("m").collect()]
    total = sum(n for _, n, _ in rows)
    if not total or len(rows) == 1:
        return {"b": None, "b_sigma": None, "rate": total / rows[0][2] if total else None, "a": None}
    mean = sum(m * n for m, n, _ in rows) / total
    for _ in range(rounds):
        s0 = sum(t * math.exp(-beta * m) for m, _, t in rows)
        s1 = sum(t * m * math.exp(-beta * m) for m, _, t in rows)
        s2 = sum(t * m * m * math.exp(-beta * m) for m, _, t in rows)
        step = (s1 / s0 - mean) / (s2 / s0 - (s1 / s0) ** 2)
        beta += step
        if abs(step) < 1e-12:
            break
    s0 = sum(t * math.exp(-beta * m) for m, _, t in rows)
    rate = total * sum(math.exp(-beta * m) for m, _, _ in rows) / s0
    variance = 1 / (total * (s2 / s0 - (s1 / s0) ** 2))
    return {"b": beta / math.log(10), "b_sigma": math.sqrt(variance) / math.log(10), "rate": rate, "a": math.log10(rate) + beta / math.log(10) * rows[0][0]}


def total_moment(rates: DataFrame, moment: Column) -> DataFrame:
    return rates.agg(F.sum(moment * F.col("rate")).alias("moment"))


def sample_magnitudes(n: int, spark, b: float, smallest: float, largest: float, seed: int = 1) -> DataFrame:
    """Synthetic magnitudes by inverse sampling: id, m; drawn in parallel."""
    from ..functions.hazard import bounded_magnitude

    return spark.range(n).select("id", bounded_magnitude(F.rand(seed), F.lit(b), F.lit(smallest), F.lit(largest)).alias("m"))


def synthetic_catalogue(spark, a: float, b: float, smallest: float, largest: float, years: float, seed: int = 1) -> DataFrame:
    """id, m, t: as many events as the rate gives, with times uniform over the duration."""
    n = int((10**a * (10 ** (-b * smallest) - 10 ** (-b * largest))) * years)
    return sample_magnitudes(n, spark, b, smallest, largest, seed).withColumn("t", F.rand(seed + 1) * years)
