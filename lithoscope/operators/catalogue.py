"""Earthquake catalogues with competing solutions for each event.

A catalogue has a row for each event: event_id, seq (order of arrival),
magnitudes and locations, arrays of structs in order of arrival.  Each solution
has a flag ``prime``; the preferred one is the last that is flagged, or the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAGNITUDE_KEYS = ("size", "type", "code", "error")
OPERATORS = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "ge": lambda a, b: a >= b,
    "le": lambda a, b: a <= b,
}


def prime(solutions: Column) -> Column:
    """The preferred solution; null if there is none."""
    flagged = F.filter(solutions, lambda s: F.coalesce(s["prime"], F.lit(False)))
    return F.coalesce(F.try_element_at(flagged, F.lit(-1)), F.try_element_at(solutions, F.lit(-1)))


def nested(solutions: DataFrame, name: str) -> DataFrame:
    """Solutions (event_id, idx, ...) as one array for each event, in order of idx."""
    fields = [c for c in solutions.columns if c != "event_id"]
    return solutions.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in fields if c != "idx"]))).alias(name))


def _array_of(key: str) -> str:
    return "magnitudes" if key in MAGNITUDE_KEYS else "locations"


def filter_solutions(catalogue: DataFrame, key: str, operator: str, value, delete_empty: bool = True) -> DataFrame:
    """Keep solutions whose ``key`` compares so with ``value``; a null fails every comparison, ``ne`` too."""
    array = _array_of(key)
    out = catalogue.withColumn(array, F.filter(array, lambda s: F.coalesce(OPERATORS[operator](s[key], F.lit(value)), F.lit(False))))
    return out.where(F.size(array) > 0) if delete_empty else out


def values(catalogue: DataFrame, key: str, remove_empty: bool = True) -> DataFrame:
    """event_id, value: ``key`` of the preferred solution."""
    out = catalogue.select("event_id", prime(F.col(_array_of(key)))[key].alias("value"))
    return out.where("value is not null") if remove_empty else out


def value_range(catalogue: DataFrame, key: str) -> DataFrame:
    return values(catalogue, key).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def sort_by(catalogue: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """By a key of the preferred solution, in order of arrival among equals; null counts as minus infinity."""
    column = F.col("event_id") if key == "event_id" else prime(F.col(_array_of(key)))[key]
    return catalogue.orderBy(column.desc_nulls_last() if reverse else column.asc_nulls_first(), "seq")


def get_event(catalogue: DataFrame, event_id) -> DataFrame:
    return catalogue.where(F.col("event_id") == event_id)


def remove(catalogue: DataFrame, event_id) -> DataFrame:
    return catalogue.where(F.col("event_id") != event_id)


def add_solution(catalogue: DataFrame, event_id, solution: Column, key: str = "magnitudes") -> DataFrame:
    """Append a solution to one event; if it is flagged, the others are not any more."""
    calm = F.transform(key, lambda s: F.when(F.coalesce(solution["prime"], F.lit(False)), s.withField("prime", F.lit(False))).otherwise(s))
    return catalogue.withColumn(key, F.when(F.col("event_id") == event_id, F.concat(calm, F.array(solution))).otherwise(F.col(key)))


def remove_solution(catalogue: DataFrame, event_id, idx: int = -1, key: str = "magnitudes") -> DataFrame:
    """Without the solution at a place of one event, from 0, or from the end if negative; nothing goes if there is none at it."""
    place = F.lit(idx) if idx >= 0 else F.size(key) + idx
    return catalogue.withColumn(key, F.when(F.col("event_id") == event_id, F.filter(key, lambda _, i: i != place)).otherwise(F.col(key)))


def _first_of_each(events: DataFrame) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("event_id").orderBy("seq"))
    return events.withColumn("_n", order).where("_n = 1").drop("_n")


def append(catalogue: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue with the events of new ids (the first of each), and the events left out."""
    known = catalogue.select("event_id")
    order = F.row_number().over(Window.partitionBy("event_id").orderBy("seq"))
    fresh = events.join(known, "event_id", "left_anti").withColumn("_n", order)
    skipped = events.join(known, "event_id", "left_semi").unionByName(fresh.where("_n > 1").drop("_n"))
    return catalogue.unionByName(fresh.where("_n = 1").drop("_n")), skipped


def upsert(catalogue: DataFrame, events: DataFrame) -> DataFrame:
    """Add events; solutions of a known id come after the stored ones, whose flags are cleared."""
    incoming = _first_of_each(events).select("event_id", *(F.col(c).alias(f"new_{c}") for c in ("seq", "magnitudes", "locations")))
    joined = catalogue.join(incoming, "event_id", "full")
    merged = []
    for c in ("magnitudes", "locations"):
        cleared = F.transform(c, lambda s: s.withField("prime", F.lit(False)))
        merged.append(F.when(F.col(c).isNull(), F.col(f"new_{c}")).when(F.col(f"new_{c}").isNull(), F.col(c)).otherwise(F.concat(cleared, F.col(f"new_{c}"))).alias(c))
    return joined.select("event_id", F.coalesce("seq", "new_seq").alias("seq"), *merged)


def hypocentre(location: Column) -> Column:
    """lon, lat and elevation in metres: depths are in kilometres, downwards."""
    return F.struct(location["lon"].alias("lon"), location["lat"].alias("lat"), (-location["depth"] * 1000).alias("elevation"))
