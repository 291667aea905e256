"""Ground-motion models as column expressions: natural log of the median, and its standard deviation.

A model is a functional form; its coefficients come as a mapping of columns or
numbers, so a set for many intensity measures is a DataFrame to join.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard gravity, and Bragato and Slejko (2005) for PGA with epicentral distance.
GRAVITY = 9.80665
BRAGATO_SLEJKO_PGA = {"a": -3.27, "b": 1.95, "c": -0.202, "d": -3.11, "e": 0.00751, "h": 8.9, "s": 0.399}
#: Atkinson (2015) for PGA.
ATKINSON_PGA = {"c0": -2.376, "c1": 1.818, "c2": -0.1153, "c3": -1.752, "phi": 0.28, "tau": 0.24, "sigma": 0.37}
#: Bragato and Slejko (2005) with epicentral distance, by measure.
BRAGATO_SLEJKO_EPICENTRAL = {
    "PGA": BRAGATO_SLEJKO_PGA,
    "PGV": {"a": -2.72, "b": 2.05, "c": -0.193, "d": -2.84, "e": 0.00709, "h": 7.3, "s": 0.369},
    "SA-0.20": {"a": -4.27, "b": 2.47, "c": -0.252, "d": -2.98, "e": 0.00745, "h": 11.1, "s": 0.361},
    "SA-1.00": {"a": -6.5, "b": 2.01, "c": -0.141, "d": -2.15, "e": 0.00436, "h": 5.8, "s": 0.347},
}
_LN10 = math.log(10.0)

Coefficients = Mapping[str, Column | float]


def bragato_slejko_2005(mag: Column, epicentral_km: Column, c: Coefficients, velocity: bool = False) -> tuple[Column, Column]:
    """Acceleration in g, or with ``velocity`` from cm/s to m/s."""
    r = F.sqrt(epicentral_km * epicentral_km + F.lit(c["h"]) * c["h"])
    log10 = c["a"] + (c["b"] + c["c"] * mag) * mag + (c["d"] + c["e"] * mag * mag * mag) * F.log10(r)
    return log10 * _LN10 - (math.log(100.0) if velocity else 0.0), F.lit(c["s"]) * _LN10


def atkinson_2015(mag: Column, hypocentral_km: Column, c: Coefficients, velocity: bool = False, total: bool = False) -> tuple[Column, Column]:
    """Acceleration from cm/s2 to g, or velocity from cm/s to m/s; the deviation is within-event unless ``total``."""
    near = F.greatest(F.lit(1.0), F.pow(F.lit(10.0), -1.72 + 0.43 * mag))
    log10 = c["c0"] + c["c1"] * mag + c["c2"] * mag * mag + c["c3"] * F.log10(F.sqrt(hypocentral_km * hypocentral_km + near * near))
    return log10 * _LN10 - math.log(100.0 * (1.0 if velocity else GRAVITY)), F.lit(c["sigma" if total else "phi"]) * _LN10


def kotha_2020(mag: Column, joyner_boore_km: Column, vs30: Column, depth_km: Column, measured: Column, c: Coefficients, c3_epsilon: float = 0.0) -> Column:
    """Log median of the regional model: magnitude hinge at 5.7, pseudo-depth by hypocentral depth, Vs30 capped at 1100."""
    dm = mag - 5.7
    source = c["e1"] + F.when(mag <= 5.7, c["b1"] * dm + c["b2"] * dm * dm).otherwise(c["b3"] * dm)
    h = F.when(depth_km <= 10, 4.0).when(depth_km > 20, 12.0).otherwise(8.0)
    r, ref = F.sqrt(joyner_boore_km * joyner_boore_km + h * h), F.sqrt(30.0**2 + h * h)
    path = (c["c1"] + c["c2"] * (mag - 4.5)) * F.log(r / ref) + (c["c3"] + c.get("tau_c3", 0.0) * c3_epsilon) * (r - ref) / 100
    v = F.log(F.least(vs30, F.lit(1100.0)))
    return source + path + F.when(measured, c["d0_obs"] + c["d1_obs"] * v).otherwise(c["d0_inf"] + c["d1_inf"] * v)


def kotha_2020_deviation(measured: Column, c: Coefficients, ergodic: bool = True) -> Column:
    """Deviation of the regional model: between events and regions, within events, and between sites unless not ``ergodic``."""
    square = lambda *keys: sum((F.lit(c[k]) * c[k] for k in keys), F.lit(0.0))
    total = square("tau_event_0", "tau_l2l", "phi_0")
    return F.sqrt(total + F.when(measured, square("phi_s2s_obs")).otherwise(square("phi_s2s_inf")) if ergodic else total)
