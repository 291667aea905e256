"""Fragility curves and damage probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hart's rational approximation of the normal distribution (double precision), highest power first.
_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    a = F.abs(x)
    density = F.exp(-a * a / 2)
    tail = F.when(a < 7.07106781186547, density * _horner(a, _TOP) / _horner(a, _BOTTOM)).otherwise(density / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631)
    return F.when(a > 37, F.when(x > 0, 1.0).otherwise(0.0)).when(x > 0, 1 - tail).otherwise(tail)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lognormal_poe(im: Column, theta: Column, beta: Column) -> Column:
    """Probability of exceedance at an intensity; 0 where it is not positive."""
    return F.when(im > 0, clip01(norm_cdf(F.log(im / theta) / beta))).otherwise(0.0)


def lognormal_poe_uncertain(median: Column, sigma: Column, theta: Column, beta: Column) -> Column:
    """The same for an intensity that is lognormal itself: the deviations add up in squares."""
    return lognormal_poe(median, theta, F.sqrt(beta * beta + sigma * sigma))


def tabulated_poe(im: Column, points: Column, log_im: bool | Column = False) -> Column:
    """Piecewise linear in the intensity or its log; ``points``: array of (im, poe) in ascending im; ends are held."""
    log = F.lit(log_im) if isinstance(log_im, bool) else log_im
    scale = lambda v: F.when(log, F.log(v)).otherwise(v)
    last, first = F.element_at(points, -1), F.element_at(points, 1)
    below = F.element_at(F.filter(points, lambda p: p["im"] <= im), -1)
    above = F.element_at(F.filter(points, lambda p: p["im"] > im), 1)
    share = (scale(im) - scale(below["im"])) / (scale(above["im"]) - scale(below["im"]))
    inside = F.when(im <= first["im"], first["poe"]).when(im >= last["im"], last["poe"]).otherwise(below["poe"] + share * (above["poe"] - below["poe"]))
    return F.when(im > 0, clip01(inside)).otherwise(0.0)


def distribution_poe(values: Column, poe_at) -> Column:
    """Mean of ``poe_at(im)`` over an array of (im, p), with p normalised."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v["p"])
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v["p"] * poe_at(v["im"])) / total


def monotone(poes: Column) -> Column:
    """Running minimum, from 1, of the clipped probabilities of an array in level order."""
    none = F.array().cast("array<double>")
    return F.aggregate(poes, none, lambda done, p: F.concat(done, F.array(F.least(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(1.0)), clip01(p)))))


def states(poes: Column) -> Column:
    """Probability of each state from those of exceedance: 1 - first, differences, and the last one as the tail."""
    before = F.concat(F.array(F.lit(1.0)), poes)
    after = F.concat(poes, F.array(F.lit(0.0)))
    return F.zip_with(before, after, lambda a, b: F.greatest(F.lit(0.0), a - b))
