"""Ambient noise: spectral ratios of two synchronous signals, and directions of horizontal spectra.

Signals are long rows; only windows of a fixed length are ever gathered, so a
long record is many small tasks, and means over windows are summed up in the
tasks before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .waveform import split_windows


def ratio(top: np.ndarray, base: np.ndarray, water: float = 1e-6) -> np.ndarray:
    """Quotient of two one-sided transforms; ``water`` is added to the power below the line, as a share of its largest.

    Where the ratio is real, its phase is 0 or pi, never -pi.
    """
    above, below = np.fft.rfft(top), np.fft.rfft(base)
    power = np.abs(below) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = above * below.conj() / (power + water * power.max(initial=0))
    out.imag += 0.0  # no negative zeros
    return out


def flanks(n: int, taper: int) -> np.ndarray:
    """Weights of a window of ``n`` samples with ``taper`` samples of cosine flank at each end."""
    edge = np.minimum(np.arange(n), np.arange(n)[::-1])
    return np.where(edge < taper, 0.5 * (1 - np.cos(math.pi * edge / max(taper, 1))), 1.0)


WINDOWED = "sid string, w long, log_amplitude array<double>, phase array<double>"


def window_ratios(samples: DataFrame, length: int, step: int, water: float = 1e-6, taper: int = 0) -> DataFrame:
    """sid, w (window), log_amplitude and phase of the ratio by frequency; ``samples``: sid, i, top, base.

    Full windows only.  A sample that one signal lacks raises, as the signals must
    be synchronous; where a ratio is zero or undefined, its logarithm is infinite or NaN.
    """
    whole = F.when(F.col("top").isNull() | F.col("base").isNull(), F.raise_error(F.lit("signals are not synchronous"))).otherwise(F.struct("top", "base"))
    cut = split_windows(samples.select("sid", "i", whole.alias("v")), length, step)
    ordered = F.array_sort(F.collect_list(F.struct("k", "v")))
    side = lambda name: F.transform("s", lambda x: x["v"][name].cast("double")).alias(name)
    rows = cut.groupBy(F.col("sid").cast("string").alias("sid"), F.col("w").cast("long").alias("w")).agg(ordered.alias("s")).select("sid", "w", side("top"), side("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = flanks(length, taper)
        for batch in batches:
            tops, bases = (batch.column(c).flatten().to_numpy().reshape(-1, length) for c in (2, 3))
            made = [ratio(x * weights, y * weights, water) for x, y in zip(tops, bases)]
            with np.errstate(divide="ignore"):
                columns = [pa.array([np.log(np.abs(m)) for m in made], pa.list_(pa.float64())), pa.array([np.angle(m) for m in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["sid", "w", "log_amplitude", "phase"])

    return rows.mapInArrow(run, WINDOWED)


def mean_ratio(samples: DataFrame, delta: float, length: int, step: int, water: float = 1e-6, taper: int = 0) -> DataFrame:
    """sid, k, freq, amplitude, phase (means of the logarithm over windows), spread (a factor), windows."""
    lines = window_ratios(samples, length, step, water, taper).select("sid", F.posexplode(F.arrays_zip("log_amplitude", "phase")).alias("k", "x"))
    size, turn = F.col("x.log_amplitude"), F.col("x.phase")
    return lines.groupBy("sid", "k").agg(
        F.exp(F.avg(size)).alias("amplitude"), F.avg(turn).alias("phase"), F.exp(F.sqrt(F.var_pop(size) + F.var_pop(turn))).alias("spread"), F.count("*").alias("windows")
    ).select("sid", "k", (F.col("k") / (length * delta)).alias("freq"), "amplitude", "phase", "spread", "windows")


def dominant_direction(spectra: DataFrame, method: str = "energy") -> DataFrame:
    """sid, theta (radians, counterclockwise from x) of spectra in long rows: sid, k, xr, xi, yr, yi."""
    x = {c: F.col(c).cast("double") for c in ("xr", "xi", "yr", "yi")}
    together, across = F.sum(x["xr"] * x["yr"] + x["xi"] * x["yi"]), F.sum(x["xi"] * x["yr"] - x["xr"] * x["yi"])
    power = F.sum(x["xr"] * x["xr"] + x["xi"] * x["xi"] - x["yr"] * x["yr"] - x["yi"] * x["yi"])
    angles = {"energy": F.atan2(2 * together, power) / 2, "cross": F.atan2(across, together), "phase": F.atan2(F.sum(x["yi"]), F.sum(x["xi"]))}
    return spectra.groupBy("sid").agg(angles[method].alias("theta"))


def combined_directions(spectra: DataFrame, method: str = "energy") -> DataFrame:
    """``spectra`` (sid, k, xr, xi, yr, yi) with theta and re, im: the spectrum along the dominant direction."""
    turned = spectra.join(dominant_direction(spectra, method), "sid")
    along = lambda part: F.col(f"x{part}") * F.cos("theta") + F.col(f"y{part}") * F.sin("theta")
    return turned.withColumns({"re": along("r"), "im": along("i")})
