"""Frequency responses of instruments, by kinds of their stages, as column expressions.

Stages are rows as ``sources.responses.read_resp`` and ``sources.models.read_stationxml``
give them.  A stage's response is a size and a phase; a channel's is the product of
the sizes and the sum of the phases, one grouping that Spark adds up in parts.

Defined results: stages without a kind are gains only; a missing gain or scale is 1,
missing roots are none and missing coefficients the polynomial 1; divisors under
1e-12 count as 1e-12.  Stage 0, the sensitivity of the whole, is left out.  A filter
in steps of samples without a rate has a null response, and so has its channel.
Polynomials are ratios in the Laplace variable.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 1e-12


def _product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda s, x: s * x)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _roots(roots: Column, omega: Column) -> tuple[Column, Column]:
    """Size and phase of the product of (s - root)."""
    held = F.coalesce(roots, F.array().cast("array<struct<Real:double,Imaginary:double>>"))
    size = _product(F.transform(held, lambda p: F.sqrt(p["Real"] * p["Real"] + (omega - p["Imaginary"]) * (omega - p["Imaginary"]))))
    return size, _sum(F.transform(held, lambda p: F.atan2(omega - p["Imaginary"], -p["Real"])))


def _polynomial(coefficients: Column, size: Column, angle: Column) -> tuple[Column, Column]:
    """Size and phase of a polynomial, lowest power first, at a complex number."""
    held = F.when(F.size(coefficients) > 0, coefficients).otherwise(F.array(F.lit(1.0)))
    part = lambda f: _sum(F.transform(held, lambda c, k: c * F.pow(size, k) * f(k * angle)))
    re, im = part(F.cos), part(F.sin)
    return F.sqrt(re * re + im * im), F.atan2(im, re)


def stage_response(freq: Column) -> tuple[Column, Column]:
    """Size and phase of a stage (kind, gain, scale, poles, zeros, numerators, denominators, rate) at a frequency in Hz."""
    omega, kind = 2 * math.pi * freq, F.col("kind")
    stepped = kind.isin("fir", "coefficients")
    radius, angle = F.when(stepped, 1.0).otherwise(omega), F.when(stepped, -omega / F.col("rate")).otherwise(math.pi / 2)
    top, up = _polynomial(F.col("numerators"), radius, angle)
    bottom, down = _polynomial(F.col("denominators"), radius, angle)
    zero, ahead = _roots(F.col("zeros"), omega)
    pole, behind = _roots(F.col("poles"), omega)
    scale, gain = F.when(kind == "paz", F.coalesce("scale", F.lit(1.0))).otherwise(1.0), F.coalesce("gain", F.lit(1.0))
    ratio = F.when(kind == "paz", zero / F.greatest(pole, F.lit(LEAST))).when(kind.isNotNull(), top / F.greatest(bottom, F.lit(LEAST))).otherwise(1.0)
    turn = F.when(kind == "paz", ahead - behind).when(kind.isNotNull(), up - down).otherwise(0.0)
    # without a rate there is nothing that greatest() may hide
    known = ~F.coalesce(stepped, F.lit(False)) | F.col("rate").isNotNull()
    return F.when(known, F.abs(gain * scale) * ratio), F.when(known, turn + F.when(gain * scale < 0, math.pi).otherwise(0.0))


def channel_response(stages: DataFrame, frequencies: Iterable[float]) -> DataFrame:
    """sid, start, end, freq, amplitude, phase (above -pi, up to pi): all stages of each epoch together."""
    freqs = sorted({float(f) for f in frequencies})
    rows = stages.where("stage > 0").withColumn("freq", F.explode(F.array(*[F.lit(f) for f in freqs]).cast("array<double>")))
    size, turn = stage_response(F.col("freq"))
    both = rows.select("sid", "start", "end", "freq", size.alias("size"), turn.alias("turn"))
    whole = both.groupBy("sid", "start", "end", "freq").agg(F.product("size").alias("amplitude"), F.sum("turn").alias("turn"), F.bool_and(F.col("size").isNotNull()).alias("known"))
    phase = math.pi - F.pmod(math.pi - F.col("turn"), F.lit(2 * math.pi))
    return whole.select("sid", "start", "end", "freq", F.when(F.col("known"), F.col("amplitude")).alias("amplitude"), F.when(F.col("known"), phase).alias("phase"))
