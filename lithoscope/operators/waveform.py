"""Time series as long rows: sid, i (sample number), t (seconds), v.

Everything is a window over one source, so Spark shuffles once by ``sid`` for a
chain of these.  ``delta`` is the sampling interval.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ground_motion import GRAVITY


def _series():
    return Window.partitionBy("sid").orderBy("i")


def _whole():
    return Window.partitionBy("sid")


def demean(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.col("v") - F.avg("v").over(_whole()))


def cumulative_trapezoid(df: DataFrame, value: Column, delta: float, name: str = "integral") -> DataFrame:
    """Running integral, 0 at the first sample."""
    step = (value + F.lag(value).over(_series())) / 2 * delta
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(name, F.sum("_step").over(_series().rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def gradient(df: DataFrame, delta: float) -> DataFrame:
    """Central differences, one-sided at the ends."""
    before, after, v = F.lag("v").over(_series()), F.lead("v").over(_series()), F.col("v")
    slope = F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2) / delta
    return df.withColumn("slope", slope)


def peak(df: DataFrame) -> DataFrame:
    """sid, peak (largest absolute value), i of its first sample."""
    size = F.abs("v")
    return df.groupBy("sid").agg(F.max(size).alias("peak"), F.min_by("i", F.struct(-size, "i")).alias("i"))


def _integral(df: DataFrame, value: Column, delta: float) -> DataFrame:
    return cumulative_trapezoid(df, value, delta, "cum")


def _area(value: Column, delta: float) -> Column:
    """Integral of a source's values by trapezoids, as an aggregate.

    All values count whole but the two at the ends.  They are added as decimals of
    ten places, so their order does not matter and Spark adds parts before it shuffles.
    """
    ends = F.min_by(value, "i") + F.max_by(value, "i")
    return (F.sum(value.cast("decimal(28,10)")).cast("double") - ends / 2) * delta


def arias_intensity(df: DataFrame, delta: float) -> DataFrame:
    return df.groupBy("sid").agg((_area(F.col("v") * F.col("v"), delta) * math.pi / (2 * GRAVITY)).alias("arias"))


def cumulative_absolute_velocity(df: DataFrame, delta: float) -> DataFrame:
    return df.groupBy("sid").agg(_area(F.abs("v"), delta).alias("cav"))


def significant_duration(df: DataFrame, delta: float, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Time between two shares of the cumulated energy; null without energy."""
    share = _integral(df, F.col("v") * F.col("v"), delta).withColumn("total", F.max("cum").over(_whole())).where("total > 0")
    first = lambda x: F.min(F.when(F.col("cum") >= x * F.col("total"), F.col("i")))
    return share.groupBy("sid").agg(((first(high) - first(low)) * delta).alias("duration"))


def bracketed_duration(df: DataFrame, threshold: float, delta: float) -> DataFrame:
    """Time from the first to the last sample that reaches the threshold; 0 if none does."""
    hit = F.when(F.abs("v") >= threshold, F.col("i"))
    return df.groupBy("sid").agg(F.coalesce((F.max(hit) - F.min(hit)) * delta, F.lit(0.0)).alias("duration"))


def root_mean_square(df: DataFrame, delta: float) -> DataFrame:
    return df.groupBy("sid").agg(F.sqrt(_area(F.col("v") * F.col("v"), delta) / F.nullif((F.count("*") - 1) * delta, F.lit(0.0))).alias("rms"))


def moving_rms(df: DataFrame, half: int) -> DataFrame:
    """Centred over 2 half + 1 samples; beyond the ends counts as zero."""
    near = _series().rowsBetween(-half, half)
    return df.withColumn("rms", F.sqrt(F.sum(F.col("v") * F.col("v")).over(near) / (2 * half + 1)))


def split_windows(df: DataFrame, length: int, step: int) -> DataFrame:
    """Full windows only: each sample once for every window it falls into (sid, w, k, v)."""
    n = F.count("*").over(_whole())
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - length + 1) / step).cast("long"))
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - length) / step))
    # a sample falls into length / step windows at most
    rows = df.withColumn("n", n).where(F.col("n") >= length).withColumn("first", first).withColumn("last", last).where("last >= first")
    return rows.withColumn("w", F.explode(F.sequence("first", "last"))).select("sid", "w", (F.col("i") - F.col("w") * step).alias("k"), "v")


def taper(df: DataFrame, alpha: float) -> DataFrame:
    """Tukey window with a share ``alpha`` of cosine flanks."""
    n = F.count("*").over(_whole()) - 1
    x = F.least(F.col("i"), n - F.col("i")) / n
    flank = 0.5 * (1 - F.cos(2 * math.pi * x / alpha)) if alpha > 0 else F.lit(1.0)
    return df.withColumn("v", F.col("v") * F.when(x < alpha / 2, flank).otherwise(1.0))


def decibel(power: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(power + floor)


def segments(df: DataFrame, most_gap: float) -> DataFrame:
    """sid, segment, begin, end, n: samples merged as long as the next follows within ``most_gap`` seconds."""
    by_time = Window.partitionBy("sid").orderBy("t", "i")
    new = F.coalesce(F.col("t") - F.lag("t").over(by_time) > most_gap, F.lit(True)).cast("int")
    numbered = df.withColumn("_new", new).withColumn("segment", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("sid", "segment").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.count("*").alias("n"))


def later_wins(df: DataFrame, cell: float) -> DataFrame:
    """One value for each cell of time: that of the record that came last."""
    return df.withColumn("cell", F.floor(F.col("t") / cell)).groupBy("sid", "cell").agg(F.max_by("v", "i").alias("v"), F.count("*").alias("n"))


def cut(df: DataFrame, begin: float, end: float) -> DataFrame:
    """Both ends inclusive; pushed down to the scan where ``t`` is a column of it."""
    return df.where(F.col("t").between(begin, end))


def overlapping(records: DataFrame, begin: float, end: float) -> DataFrame:
    """Records (begin, end) that share any time with a window, ends included; empty ones do not."""
    return records.where((F.col("n") > 0) & (F.col("begin") <= end) & (F.col("end") >= begin))


def spectral_peaks(df: DataFrame) -> DataFrame:
    """Samples strictly above both neighbours."""
    v = F.abs("v")
    up, down = F.lag(v).over(_series()), F.lead(v).over(_series())
    return df.withColumn("_p", (v > up) & (v > down)).where("_p").drop("_p")


def epoch_join(records: DataFrame, epochs: DataFrame) -> DataFrame:
    """Records (sid, t) with the responses (sid, start, end, ...) in force: start <= t < end, null bounds open."""
    on = (records.sid == epochs.sid) & ((records.t >= epochs.start) | epochs.start.isNull()) & ((records.t < epochs.end) | epochs.end.isNull())
    return records.join(epochs, on).drop(epochs.sid)
