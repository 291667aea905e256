"""Hazard and source parameters as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisson_probability(rate: Column, years: float = 50.0) -> Column:
    return 1 - F.exp(-rate * years)


def poisson_rate(probability: Column, years: float = 50.0) -> Column:
    return -F.log(1 - probability) / years


def moment_to_magnitude(moment_dyne_cm: Column) -> Column:
    return F.log10(moment_dyne_cm) * (2.0 / 3.0) - 10.7


def magnitude_to_moment(magnitude: Column, as_coded: bool = False) -> Column:
    """The inverse of ``moment_to_magnitude``; ``as_coded`` gives 10^(1.5 m + 10.7), which is not."""
    return F.pow(F.lit(10.0), 1.5 * magnitude + 10.7 if as_coded else (magnitude + 10.7) * 1.5)


def bounded_cumulative_rate(magnitude: Column, a: Column, b: Column, largest: Column) -> Column:
    """Gutenberg-Richter rate of events from a magnitude on, none beyond the largest."""
    ten = F.lit(10.0)
    return F.when(magnitude > largest, 0.0).otherwise(F.pow(ten, a) * (F.pow(ten, -b * magnitude) - F.pow(ten, -b * largest)))


def bounded_magnitude(u: Column, b: Column, smallest: Column, largest: Column) -> Column:
    """Inverse of the bounded distribution at a probability."""
    return smallest - F.log10(1 - u * (1 - F.pow(F.lit(10.0), -b * (largest - smallest)))) / b


# Fixed values of the next two: the standard formula of IASPEI (2011), and Hutton and Boore (1987).


def ml_iaspei(amplitude_nm: Column, distance_km: Column) -> Column:
    return F.log10(amplitude_nm) + 1.11 * F.log10(distance_km) + 0.00189 * distance_km - 2.09


def ml_hutton_boore(amplitude: Column, distance_km: Column) -> Column:
    return F.log10(amplitude) + 1.105 * F.log10(distance_km) + 147.111 * F.log10(distance_km * 4.015e-5 + 1.33885) - 18.0471


#: Wells and Coppersmith (1994), magnitude from rupture area in km2: intercept, slope of log10, deviation.
AREA_TO_MAGNITUDE = {"generic": (4.07, 0.98, 0.24), "normal": (3.93, 1.02, 0.25), "reverse": (4.33, 0.90, 0.25), "strike-slip": (3.98, 1.02, 0.23)}
#: The same authors, log10 of area from magnitude.
MAGNITUDE_TO_AREA = {"generic": (-3.49, 0.91, 0.24), "normal": (-2.87, 0.82, 0.22), "reverse": (-3.99, 0.98, 0.26), "strike-slip": (-3.42, 0.90, 0.22)}


def _by_style(style: Column, table: dict, k: int) -> Column:
    out = F.lit(table["generic"][k])
    for name, row in table.items():
        out = F.when(style == name, row[k]).otherwise(out)
    return out


def area_to_magnitude(area_km2: Column, style: Column) -> Column:
    return _by_style(style, AREA_TO_MAGNITUDE, 0) + _by_style(style, AREA_TO_MAGNITUDE, 1) * F.log10(area_km2)


def magnitude_to_area(magnitude: Column, style: Column) -> Column:
    return F.pow(F.lit(10.0), _by_style(style, MAGNITUDE_TO_AREA, 0) + _by_style(style, MAGNITUDE_TO_AREA, 1) * magnitude)


def baker_jayaram(t1: Column, t2: Column) -> Column:
    """Correlation of spectral accelerations at two periods (Baker and Jayaram, 2008)."""
    low, high = F.least(t1, t2), F.greatest(t1, t2)
    c1 = 1 - F.cos(math.pi / 2 - 0.366 * F.log(high / F.greatest(low, F.lit(0.109))))
    c2 = F.when(high < 0.2, 1 - 0.105 * (1 - 1 / (1 + F.exp(100 * high - 5))) * (high - low) / (high - 0.0099)).otherwise(0.0)
    c3 = F.when(high < 0.109, c2).otherwise(c1)
    c4 = c1 + 0.5 * (F.sqrt(c3) - c3) * (1 + F.cos(math.pi * low / 0.109))
    return F.when(high <= 0.109, c2).when(low > 0.109, c1).when(high < 0.2, F.least(c2, c4)).otherwise(c4)
