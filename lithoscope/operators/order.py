"""The order of a frame's rows as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """``ordered`` with the place of each row, from 0, in the order it has; columns ``_at`` and ``_part`` must not be taken.

    The rows are written once in their order, numbered within each task; only the
    counts of tasks, a row each, meet in one.
    """
    lying = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftrightunsigned("_at", 33))
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = lying.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return lying.join(counts, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")
