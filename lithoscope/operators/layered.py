"""Waves in layered media: dispersion of surface waves, its kernels, and the response to incident waves.

A profile is an array of layers (hl, vs, dn, and vp or a ratio to vs; the last one
is the half-space); velocities, thickness and density may be in any units that fit
each other.  Profiles with equally
many layers are worked on together, for all periods, trial velocities and modes at
once, over Arrow batches.

Rayleigh waves: depth is counted in wavelengths (times 2 pi), so that the matrix of
motion and stress holds the phase velocity alone.  Its 2 x 2 minors are carried up
through each layer as minors of the two potentials and their slopes, which P and S
waves turn separately, in real numbers; no large terms cancel.  Minors start from
the two waves that decay below; at a mode the one of the two stresses vanishes at
the surface.  Love waves: motion and stress, likewise.

Modes are the roots below the half-space's shear velocity, in order.  The same pass
counts the modes below a trial velocity (Wittrick and Williams): those of each
layer between clamped faces, and what is negative in the stiffnesses where layers
meet and at the surface.  So a mode is bracketed by halving until its bracket holds
no other one, then found by inverse interpolation; however close roots are, none is
missed.  The count grows with velocity where no mode runs backwards.  Love waves
have none; Rayleigh waves were seen to have some from 3.3 times the slowest shear
velocity on, and counts get lost in rounding where a layer is some 1000 times as
fast as another.  So profiles whose half-space is more than ``FORWARD`` times, or any
layer more than ``STIFF`` times, as fast as their slowest layer are searched for changes of sign between ``STEPS`` trial
velocities; two of their roots within one step are missed.

Group velocity comes from the phase velocities at two periods, 2.5 percent off.
Kernels are derivatives of the root, -(dF/dp)/(dF/dc), so no root is searched again.

Defined results: no velocity (null) beyond a mode's cut-off, for profiles with
fewer than two layers in Love waves, and where a layer has a null or non-positive
value (thickness of the last layer does not count); periods must be positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, FORWARD, STIFF, EXACT, OFF, NUDGE = 400, 2.0, 100.0, 2.0**-51, 0.025, 1e-5
#: Trial velocities, and profiles, that are worked on together.
TOGETHER, PROFILES = 1 << 15, 1024
PARAMETERS = ("hl", "vp", "vs", "dn")


@dataclass
class Layers:
    hl: np.ndarray
    vp: np.ndarray
    vs: np.ndarray
    dn: np.ndarray

    def alone(self) -> Layers:
        """As the only one of several profiles."""
        return Layers(*(x[:, None] for x in (self.hl, self.vp, self.vs, self.dn)))

    def at(self, profiles: np.ndarray, more: tuple[int, ...] = ()) -> Layers:
        """Of several profiles, the values for each of ``profiles``, with further axes."""
        return Layers(*(x[:, profiles].reshape(len(x), len(profiles), *more) for x in (self.hl, self.vp, self.vs, self.dn)))

    @classmethod
    def of(cls, layers: list[dict], vp_ratio: float) -> Layers | None:
        get = lambda k: np.array([np.nan if x.get(k) is None else x[k] for x in layers], float)
        out = cls(get("hl"), get("vp"), get("vs"), get("dn")).filled(vp_ratio)
        return out if len(layers) and out.good() else None

    def filled(self, vp_ratio: float) -> Layers:
        return replace(self, vp=np.where(np.isnan(self.vp), self.vs * vp_ratio, self.vp))

    def good(self) -> np.ndarray:
        """Whether values are above zero, of each profile."""
        return (self.hl[:-1] > 0).all(0) & (self.vp > 0).all(0) & (self.vs > 0).all(0) & (self.dn > 0).all(0)


def _turn(q: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cosh and sinh (over the rate) of a way at a squared rate of decay (cos and sin where it is negative), both less by the growing wave's size, and 1 less by it."""
    rate = np.sqrt(np.abs(q))
    x, decays = rate * h, q > 0
    small = np.exp(np.where(decays, -x, 0))
    cosh, sinh = (1 + small * small) / 2, (1 - small * small) / 2
    if not decays.all():
        cosh, sinh = np.where(decays, cosh, np.cos(x)), np.where(decays, sinh, np.sin(x))
    near = x < 1e-6
    return cosh, np.where(near, h * small, sinh / np.where(near, 1, rate)), small


def _love(c: np.ndarray, kh: Callable[[int], np.ndarray], m: Layers, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    mu, scale, n = m.dn * m.vs**2, m.dn[-1] * m.vs[-1] ** 2, np.zeros_like(c)
    u, t = np.ones_like(c), -mu[-1] / scale * np.sqrt(np.maximum(1 - (c / m.vs[-1]) ** 2, 0))
    for j in range(len(m.vs) - 2, -1, -1):
        h, g, q, below = kh(j), mu[j] / scale, 1 - (c / m.vs[j]) ** 2, u
        cosh, sinh, _ = _turn(q, h)
        u, t = u * cosh - t * sinh / g, t * cosh - u * g * q * sinh
        if counted:  # places without motion
            clamped = np.floor(np.sqrt(np.maximum(-q, 0)) * h / np.pi)
            n += clamped + ((u * below < 0) != (clamped % 2 == 1))
        most = np.maximum(np.abs(u), np.abs(t))
        u, t = u / most, t / most
    return t, n + (t * u > 0)


def _firm(minors: list[np.ndarray], h: np.ndarray, cc: np.ndarray, vp: np.ndarray, vs: np.ndarray, dn: np.ndarray) -> list[np.ndarray]:
    """Minors (12, 13, 14, 23, 34) above a layer that is much faster than the squared velocity ``cc``, where those of potentials would cancel.

    They obey a system whose exponential is a polynomial of degree four, as its
    eigenvalues are sums and differences of the two rates of decay.
    """
    a, b = np.sqrt(1 - cc / vp**2), np.sqrt(1 - cc / vs**2)
    s, d = a + b, cc * (1 / vs**2 - 1 / vp**2) / (a + b)
    d, gap, eb = np.where(np.abs(d) < 1e-30, 1e-30, d), 4 * a * b, np.exp(-b * h)
    part, small = -np.expm1(-s * h), np.exp(-s * h)
    even, odd = part * part / 2 / (s * s), part * (1 + small) / 2 / s
    c4, c3 = (even - (eb * np.expm1(-d * h) / d) ** 2 / 2) / gap, (odd + eb * eb * np.expm1(-2 * d * h) / (2 * d)) / gap
    mu, e, g = dn * vs**2, 1 / (dn * vp**2), dn * cc
    low, q = 1 - 2 * mu * e, 4 * mu * (1 - mu * e) - g
    terms, total = minors, [small * v for v in minors]
    for w in (c3 * s * s - odd, even - c4 * s * s, -c3, c4):  # upwards, so odd powers change sign
        m12, m13, m14, m23, m34 = terms
        terms = [-m23 / mu + e * m14, m23 + low * m14, m34 / mu - g * m12 - 2 * m13, -2 * low * m13 - e * m34 - q * m12, q * m14 + g * m23]
        total = [x + w * v for x, v in zip(total, terms)]
    return total


def _clamped(qp: np.ndarray, qs: np.ndarray, h: np.ndarray, p: tuple, s: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Along and down, the stiffness of a layer whose other face is held, over density times squared velocity and times the third."""
    (cp, sp, ep), (cs, ss, es) = p, s
    one, two, small = sp * cs, ss * cp, ep * es
    size = (1 + qp * qs) * sp * ss - 2 * (cp * cs - small)
    thin = h * np.maximum(1, np.maximum(np.abs(qp), np.abs(qs))) < 0.02
    if thin.any():  # the difference is lost in rounding there; a series in its stead
        a, b, hh = 1 - qp, 1 - qs, h * h
        size = np.where(thin, hh * small * (a * b + hh * (a + b) * (a + b - 2 * a * b) / 12), size)
    return two - qp * one, one - qs * two, size


def _held(qp: np.ndarray, qs: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Modes of a layer with both faces held: twice those of its half, and what is negative at the half's face; a layer has none within half a wave of S."""
    n = np.zeros_like(h)
    own = np.flatnonzero(-qs.ravel() * h.ravel() ** 2 >= np.pi**2)
    if len(own):
        qp, qs, h = (x.ravel()[own] for x in (qp, qs, h))
        found, twice = np.zeros(len(own)), 1.0
        for _ in range(64):
            live = -qs * h * h >= np.pi**2
            if not live.any():
                break
            h = np.where(live, h / 2, h)
            along, down, size = _clamped(qp, qs, h, _turn(qp, h), _turn(qs, h))
            found += np.where(live, twice * ((along * size < 0) * 1.0 + (down * size < 0)), 0)
            twice *= 2
        n.ravel()[own] = found
    return n


def _rayleigh(c: np.ndarray, kh: Callable[[int], np.ndarray], m: Layers, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    # velocities and densities in those of the half-space
    vp, vs, dn, c = m.vp / m.vs[-1], m.vs / m.vs[-1], m.dn / m.dn[-1], c / m.vs[-1]
    cc, n = c * c, np.zeros_like(c)
    ra, rb = (np.sqrt(np.maximum(1 - cc / v**2, 0)) for v in (vp[-1], vs[-1]))
    e, g, both = 2 * dn[-1] * vs[-1] ** 2, dn[-1] * cc, ra * rb
    # minors of motion along and down and stress along and down; 24 is the negative of 13
    m12, m13, m14, m23, m34 = both - 1, e - g - e * both, g * rb, -g * ra, (e - g) ** 2 - e * e * both
    for j in range(len(vs) - 2, -1, -1):
        h, qp, qs = kh(j), 1 - cc / vp[j] ** 2, 1 - cc / vs[j] ** 2
        e, g = 2 * dn[j] * vs[j] ** 2, dn[j] * cc
        (cp, sp, ep), (cs, ss, es) = p, s = _turn(qp, h), _turn(qs, h)
        along, below = m23 / m12, m12
        firm = np.broadcast_to(cc * 9 < vs[j] ** 2, c.shape)
        if firm.any():
            exact = _firm([v[firm] for v in (m12, m13, m14, m23, m34)], *(np.broadcast_to(v, c.shape)[firm] for v in (h, cc, vp[j], vs[j], dn[j])))
        # of potentials: P, its slope, S, its slope; 34 is the negative of 12
        p13 = (m34 - e * (2 * m13 + e * m12)) / (g * g)
        p12 = -(m13 + e * m12) / g - p13
        p24, p14, p23 = m12 + 2 * p12 + p13, -m14 / g, m23 / g
        p13, p23 = cp * p13 - sp * p23, cp * p23 - qp * sp * p13
        p14, p24 = cp * p14 - sp * p24, cp * p24 - qp * sp * p14
        p13, p14 = cs * p13 - ss * p14, cs * p14 - qs * ss * p13
        p23, p24 = cs * p23 - ss * p24, cs * p24 - qs * ss * p23
        p12, d = p12 * (ep * es), e - g
        m12, m13, m14, m23, m34 = p24 - p13 - 2 * p12, (d + e) * p12 + d * p13 - e * p24, -g * p14, g * p23, 2 * e * d * p12 - e * e * p24 + d * d * p13
        if firm.any():
            for v, w in zip((m12, m13, m14, m23, m34), exact):
                v[firm] = w
        if counted:
            own, _, size = _clamped(qp, qs, h, p, s)
            n += np.where(m12 * below * size < 0, 1, 2 * (g * own / size + along < 0)) + _held(qp, qs, h)
        most = np.maximum(np.maximum(np.maximum(np.abs(m12), np.abs(m13)), np.maximum(np.abs(m14), np.abs(m23))), np.abs(m34))
        m12, m13, m14, m23, m34 = m12 / most, m13 / most, m14 / most, m23 / most, m34 / most
    return m34, n + np.where(m34 * m12 < 0, 1, 2 * (m23 * m12 < 0))


WAVES = {"rayleigh": _rayleigh, "love": _love}


def secular(wave: str, c: np.ndarray, period: np.ndarray, m: Layers) -> np.ndarray:
    """What vanishes at a mode, up to a factor above zero."""
    return _passed(wave, c, period, m, False)[0]


def _passed(wave: str, c: np.ndarray, period: np.ndarray, m: Layers, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """What vanishes at a mode, and how many modes are slower."""
    k = 2 * np.pi / (period * c)
    return WAVES[wave](c, lambda j: m.hl[j] * k, m, counted)


def _every_phase(wave: str, t: np.ndarray, m: Layers, modes: int, steps: int) -> np.ndarray:
    """Velocities of profiles with equally many layers (values are layers by profiles): profiles by periods by modes."""
    out = np.full((m.vs.shape[1], len(t), modes), np.nan)
    low, high = m.vs.min(0) * (0.8 if wave == "rayleigh" else 1), m.vs[-1]
    if wave == "love" and len(m.vs) < 2:
        return out
    some = (low < high) & np.isfinite(high)
    forward = np.full(len(high), wave == "love") | ((high <= FORWARD * m.vs.min(0)) & (m.vs.max(0) <= STIFF * m.vs.min(0)))
    for own in _parts(np.flatnonzero(some & forward), len(t) * modes):
        pair = np.repeat(own, len(t))
        out[own] = _by_count(wave, np.tile(t, len(own)), m.at(pair), low[pair], high[pair], modes).reshape(len(own), len(t), modes)
    for own in _parts(np.flatnonzero(some & ~forward), len(t) * steps):
        out[own] = _by_steps(wave, t, m.at(own, (1, 1)), low[own, None, None], high[own, None, None], modes, steps)
    return out


def _parts(own: np.ndarray, each: int) -> Iterator[np.ndarray]:
    width = max(1, TOGETHER // each)
    return (own[k : k + width] for k in range(0, len(own), width))


def _by_count(wave: str, t: np.ndarray, m: Layers, low: np.ndarray, high: np.ndarray, modes: int) -> np.ndarray:
    """The first roots between velocities, of pairs of a profile and a period: pairs by modes."""
    out = np.full((len(t), modes), np.nan)
    with np.errstate(all="ignore"):
        ends = [(x, *_passed(wave, x, t, m)) for x in (low, high)]
        pair, mode = np.nonzero(ends[0][2][:, None] + np.arange(modes) < ends[1][2][:, None])
        want = ends[0][2][pair] + mode
        out[pair, mode] = _root(lambda x, k: _passed(wave, x, t[pair[k]], m.at(pair[k])), want, *([v[pair] for v in end] for end in ends))
    return out


def _by_steps(wave: str, t: np.ndarray, m: Layers, low: np.ndarray, high: np.ndarray, modes: int, steps: int) -> np.ndarray:
    """The first changes of sign between steps of velocity: profiles by periods by modes."""
    out = np.full((len(low), len(t), modes), np.nan)
    c = np.minimum(low * (high / low) ** (np.arange(steps + 1) / steps), high)
    c = np.broadcast_to(c, (len(low), len(t), steps + 1)).copy()
    f = secular(wave, c, t[:, None], m)
    profile, row, at = np.nonzero(f[:, :, :-1] * f[:, :, 1:] < 0)
    key = profile * len(t) + row
    mode = np.arange(len(key)) - np.searchsorted(key, key)
    profile, row, at, mode = (v[mode < modes] for v in (profile, row, at, mode))
    if len(profile):
        first = f[profile, row, at]
        m = Layers(*(x[:, :, 0, 0] for x in (m.hl, m.vp, m.vs, m.dn)))

        def slower(x: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            value = secular(wave, x, t[row[k]], m.at(profile[k]))
            return value, (value * first[k] < 0) * 1.0

        with np.errstate(all="ignore"):
            out[profile, row, mode] = _root(slower, np.zeros(len(row)), *((c[profile, row, k], f[profile, row, k], np.full(len(row), n)) for k, n in ((at, 0.0), (at + 1, 1.0))))
    return out


def _root(f: Callable[[np.ndarray, np.ndarray], tuple], want: np.ndarray, low: Sequence[np.ndarray], high: Sequence[np.ndarray]) -> np.ndarray:
    """Roots with ``want`` others below them, between ends (place, value, number of roots below), of a function of places and of which roots they are for.

    Ends are halved until one root is left between them; then Chandrupatla's rule
    takes the inverse parabola through three points, or halves.
    """
    out, live = np.full(len(want), np.nan), np.arange(len(want))
    (a, fa, na), (b, fb, nb), share, step = low, high, np.full(len(want), 0.5), 0
    while len(live):
        x = a + share * (b - a)
        fx, nx = f(x, live)
        same = (nx <= want) == (na <= want)
        c, fc = np.where(same, a, b), np.where(same, fa, fb)
        b, fb, nb = np.where(same, b, a), np.where(same, fb, fa), np.where(same, nb, na)
        a, fa, na, step = x, fx, nx, step + 1
        alone, best = np.abs(na - nb) == 1, np.where(np.abs(fa) < np.abs(fb), a, b)
        least = EXACT * np.abs(best) / np.abs(b - a)
        over = ~(least <= 0.5) | (alone & (fa == 0))
        if over.any():
            out[live[over]] = np.where(np.isfinite(fa) & np.isfinite(fb), best, np.nan)[over]
            live, want, a, fa, na, b, fb, nb, c, fc, alone, least = (v[~over] for v in (live, want, a, fa, na, b, fb, nb, c, fc, alone, least))
        xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
        fits = alone & (phi * phi < xi) & ((1 - phi) ** 2 < 1 - xi) & (step < 60)
        share = np.where(fits, fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb), 0.5)
        share = np.clip(share, least, 1 - least)
    return out


def phase_velocity(wave: str, periods: Sequence[float], m: Layers, modes: int = 1, steps: int = STEPS) -> np.ndarray:
    """Velocities, periods by modes; nan where a mode does not exist."""
    return _every_phase(wave, np.asarray(periods, float), m.alone(), modes, steps)[0]


def _every_velocity(wave: str, t: np.ndarray, m: Layers, modes: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Phase and group velocities: profiles by periods by modes."""
    one, two = t / (1 + OFF), t / (1 - OFF)
    phase, a, b = np.split(_every_phase(wave, np.concatenate([t, one, two]), m, modes, steps), 3, axis=1)
    return phase, (1 / one - 1 / two)[:, None] / (1 / (one[:, None] * a) - 1 / (two[:, None] * b))


def group_velocity(wave: str, periods: Sequence[float], m: Layers, modes: int = 1, steps: int = STEPS) -> np.ndarray:
    return _every_velocity(wave, np.asarray(periods, float), m.alone(), modes, steps)[1][0]


def _slope(wave: str, c: np.ndarray, t: np.ndarray, m: Layers, name: str, j: int) -> np.ndarray:
    """Derivative of roots by one layer's parameter."""
    value = getattr(m, name)

    def moved(sign: int) -> np.ndarray:
        other = value.copy()
        other[j] *= 1 + sign * NUDGE
        return secular(wave, c, t, replace(m, **{name: other}))

    by_p = (moved(1) - moved(-1)) / (2 * NUDGE * value[j])
    by_c = (secular(wave, c * (1 + NUDGE), t, m) - secular(wave, c * (1 - NUDGE), t, m)) / (2 * NUDGE * c)
    return -by_p / by_c


def _every_kernel(wave: str, t: np.ndarray, m: Layers, modes: int, group: bool) -> np.ndarray:
    """Profiles by periods by modes by PARAMETERS by layers."""
    out = np.full((m.vs.shape[1], len(t), modes, len(PARAMETERS), len(m.vs)), np.nan)
    times = (t / (1 + OFF), t / (1 - OFF)) if group else (t,)
    found = [_every_phase(wave, x, m, modes, STEPS) for x in times]
    some = ~np.isnan(found).any(0)
    profile, row, _ = np.nonzero(some)
    grid, own = [x[row] for x in times], m.at(profile)
    for i, name in enumerate(PARAMETERS):
        for j in range(len(m.vs)):
            if (name == "hl" and j == len(m.vs) - 1) or (name == "vp" and wave == "love"):
                out[some, i, j] = 0.0
                continue
            slopes = [_slope(wave, c[some], x, own, name, j) for c, x in zip(found, grid)]
            if group:
                # U = (f1 - f2) / (f1 / c1 - f2 / c2)
                (c1, c2), (t1, t2) = (c[some] for c in found), grid
                below = 1 / (t1 * c1) - 1 / (t2 * c2)
                slopes = [(1 / t1 - 1 / t2) / below**2 * (slopes[0] / (t1 * c1 * c1) - slopes[1] / (t2 * c2 * c2))]
            out[some, i, j] = slopes[0]
    return out


def kernels(wave: str, periods: Sequence[float], m: Layers, modes: int = 1, group: bool = False) -> np.ndarray:
    """Derivatives of velocities: periods by modes by PARAMETERS by layers (nan where a mode does not exist)."""
    return _every_kernel(wave, np.asarray(periods, float), m.alone(), modes, group)[0]


# waves from below


def incident(freq: np.ndarray, wave: str, angle: float, m: Layers, qp: np.ndarray | None = None, qs: np.ndarray | None = None, depth: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical motion (complex) at a depth, for a P or SV wave of unit motion that comes up at an angle (radians).

    Propagators of motion and stress, 4 x 4, for all frequencies at once.  Layers
    are damped by ``qp`` and ``qs``, the half-space is not; the depth lies above it.
    """
    freq = np.maximum(np.asarray(freq, float), 1e-6)
    vp, vs = m.vp.astype(complex), m.vs.astype(complex)
    if qp is not None:
        vp[:-1] /= 1 - 0.5j / qp[:-1]
    if qs is not None:
        vs[:-1] /= 1 - 0.5j / qs[:-1]
    w, p = 2 * np.pi * freq, np.sin(angle) / (m.vp[-1] if wave == "p" else m.vs[-1])
    # stresses in units of frequency, so that the matrix does not hold it
    state = np.zeros((len(freq), 4, 2), complex)
    state[:, 0, 0] = state[:, 1, 1] = 1
    there, above = None, 0.0
    for j in range(len(vs)):
        if there is None and (depth < above + m.hl[j] or j == len(vs) - 1):
            there = _carried(state, w * (depth - above), p, vp[j], vs[j], m.dn[j])
        if j < len(vs) - 1:
            state, above = _carried(state, w * m.hl[j], p, vp[j], vs[j], m.dn[j]), above + m.hl[j]
    up = [1j * np.sqrt(1 / v**2 - p * p + 0j) for v in (vp[-1], vs[-1])]
    mu, dn = m.dn[-1] * vs[-1] ** 2, m.dn[-1]
    columns = [v for sign in (1, -1) for v in ((p, -sign * up[0], 2 * mu * sign * up[0] * p, dn - 2 * mu * p * p), (sign * up[1], -p, mu * (up[1] ** 2 + p * p), -2 * mu * p * sign * up[1]))]
    rising = np.linalg.solve(np.array(columns).T[None], state)[:, :2]
    unit = np.array([m.vp[-1], 0] if wave == "p" else [0, m.vs[-1]], complex)
    surface = np.linalg.solve(rising, np.broadcast_to(unit, (len(freq), 2))[:, :, None])
    out = (there @ surface)[:, :, 0]
    return out[:, 0], out[:, 1]


def _carried(state: np.ndarray, x: np.ndarray, p: float, vp: complex, vs: complex, dn: float) -> np.ndarray:
    """Motion and stress a way (times frequency) further down in a layer."""
    mu, e = dn * vs**2, 1 / (dn * vp**2)
    lam = dn * vp**2 - 2 * mu
    a = np.array([[0, p, 1 / mu, 0], [-p * lam * e, 0, 0, e], [4 * p * p * mu * (lam + mu) * e - dn, 0, 0, p * lam * e], [0, -dn, -p, 0]], complex)
    squares = np.array([p * p - 1 / vp**2, p * p - 1 / vs**2])
    r = np.sqrt(squares + 0j)
    cosh, sinh = np.cosh(r * x[:, None]), np.where(np.abs(r) > 0, np.sinh(r * x[:, None]) / np.where(np.abs(r) > 0, r, 1), x[:, None])
    (c2, c3), gap = ((f[:, 0] - f[:, 1]) for f in (cosh, sinh)), squares[0] - squares[1]
    c2, c3 = c2 / gap, c3 / gap
    c0, c1 = cosh[:, 0] - c2 * squares[0], sinh[:, 0] - c3 * squares[0]
    parts = [np.eye(4), a, a @ a, a @ a @ a]
    return sum(c[:, None, None] * q for c, q in zip((c0, c1, c2, c3), parts)) @ state


def sh_at_depth(freq: np.ndarray, hl: np.ndarray, vs: np.ndarray, dn: np.ndarray, qs: np.ndarray | None = None, depth: float = 0.0, angle: float = 0.0) -> np.ndarray:
    """Motion (complex) at a depth over that of a rising SH wave of unit motion in the half-space: 2 at a free surface.

    Motion and stress from the surface down, all frequencies at once; ``qs`` damps
    the layers, the half-space is not damped.
    """
    freq, vs = np.asarray(freq, float), np.asarray(vs, complex)
    slow = np.sin(angle) / vs[-1].real
    if qs is not None:
        vs[:-1] /= 1 - 0.5j / np.asarray(qs, float)[:-1]
    mu = np.asarray(dn) * vs**2
    eta = np.sqrt(1 / vs**2 - slow**2)
    w = 2 * np.pi * freq
    u, t, there, above = np.ones(len(freq), complex), np.zeros(len(freq), complex), None, 0.0

    def further(way: float, j: int) -> tuple[np.ndarray, np.ndarray]:
        x = w * eta[j] * way
        return u * np.cos(x) + t * np.sin(x) / (mu[j] * eta[j]), -u * mu[j] * eta[j] * np.sin(x) + t * np.cos(x)

    for j in range(len(vs)):
        if there is None and (j == len(vs) - 1 or depth < above + hl[j]):
            there = further(depth - above, j)[0]
        if j < len(vs) - 1:
            u, t = further(hl[j], j)
            above += hl[j]
    # stress is in units of frequency; a rising wave has stress i mu eta
    rising = (u + t / (1j * mu[-1] * eta[-1])) / 2
    return there / rising


# frames


def _over_profiles(profiles: DataFrame, schema: str, work: Callable[[pa.Array], tuple[Sequence[int], list]]) -> DataFrame:
    """Rows that ``work`` makes of the layers of profiles (site, layers), as each row's profile and columns; dealt out to all tasks as profiles are few and dear."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, PROFILES):
                sites, layers = whole.slice(k, PROFILES).columns
                at, columns = work(layers)
                kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]
                columns = [c if isinstance(c, pa.Array) else pa.array(c, kind, from_pandas=True) for c, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([sites.take(pa.array(at, pa.int64())), *columns], names=["site", *names])

    kind, spark = profiles.schema["site"].dataType.simpleString(), profiles.sparkSession
    dealt = profiles.select("site", "layers").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, f"site {kind}, {schema}")


def _turned(rows: list[list[tuple]], width: int) -> tuple[list[int], list]:
    """Rows of each profile as each row's profile and columns."""
    return [k for k, own in enumerate(rows) for _ in own], [[r[i] for own in rows for r in own] for i in range(width)]


def _alike(profiles: pa.Array, vp_ratio: float) -> Iterator[tuple[np.ndarray, Layers]]:
    """The valid ones of profiles by their number of layers: places and values, layers by profiles."""
    sizes = pc.fill_null(pc.list_value_length(profiles), 0).to_numpy(zero_copy_only=False)
    flat, begins = profiles.flatten(), np.cumsum(sizes) - sizes
    parts = dict(zip((f.name for f in flat.type), flat.flatten()))
    none = np.full(len(flat), np.nan)
    values = [pc.cast(parts[k], pa.float64()).to_numpy(zero_copy_only=False) if k in parts else none for k in ("hl", "vp", "vs", "dn")]
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        m = Layers(*(v[begins[at] + np.arange(size)[:, None]] for v in values)).filled(vp_ratio)
        good = np.flatnonzero(m.good())
        if len(good):
            yield at[good], m.at(good)


def dispersion(profiles: DataFrame, periods: Sequence[float], waves: Sequence[str] = ("rayleigh", "love"), modes: int = 1, vp_ratio: float = 3**0.5) -> DataFrame:
    """site, wave, mode, period, phase, grp (velocities, null beyond a cut-off): a row for each of them, of profiles (site, layers)."""
    t = np.asarray(periods, float)

    def work(own: pa.Array) -> tuple[np.ndarray, list]:
        both = np.full((2, len(own), len(waves), len(t), modes), np.nan)
        for at, m in _alike(own, vp_ratio):
            for w, wave in enumerate(waves):
                both[0, at, w], both[1, at, w] = _every_velocity(wave, t, m, modes)
        at, w, i, k = (x.ravel() for x in np.indices(both.shape[1:]))
        return at, [pa.array(waves, pa.string()).take(pa.array(w)), k, t[i], both[0].ravel(), both[1].ravel()]

    return _over_profiles(profiles, "wave string, mode int, period double, phase double, grp double", work)


def sensitivity(profiles: DataFrame, periods: Sequence[float], waves: Sequence[str] = ("rayleigh", "love"), modes: int = 1, group: bool = False, vp_ratio: float = 3**0.5) -> DataFrame:
    """site, wave, mode, period, parameter, layer (from 1), slope: how velocities follow each parameter of each layer."""
    t = np.asarray(periods, float)

    def work(own: pa.Array) -> tuple[list[int], list]:
        out: list[list[tuple]] = [[] for _ in own]
        for at, m in _alike(own, vp_ratio):
            for wave in waves:
                for p, k in zip(at, _every_kernel(wave, t, m, modes, group)):
                    out[p] += [(wave, i, float(t[a]), name, j + 1, float(k[a, i, b, j])) for a in range(len(t)) for i in range(modes) for b, name in enumerate(PARAMETERS) for j in range(k.shape[-1])]
        return _turned(out, 6)

    return _over_profiles(profiles, "wave string, mode int, period double, parameter string, layer int, slope double", work)


def response(profiles: DataFrame, freq: Sequence[float], wave: str = "sv", angle: float = 0.0, depth: float = 0.0, vp_ratio: float = 3**0.5) -> DataFrame:
    """site, freq, horizontal, vertical: amplitudes at a depth for an incident wave (p, sv; sh has no vertical motion) of unit motion.

    Layers may have qs (and qp, else qs) for damping.
    """
    freq = [float(f) for f in freq]

    def one(layers: list[dict]) -> list[tuple]:
        m = Layers.of(layers, vp_ratio)
        if m is None:
            return [(f, np.nan, np.nan) for f in freq]
        q = lambda k: np.array([x.get(k) or x.get("qs") or np.inf for x in layers], float)
        if wave == "sh":
            h, v = sh_at_depth(np.array(freq), m.hl, m.vs, m.dn, q("qs"), depth, angle), np.zeros(len(freq))
        else:
            h, v = incident(np.array(freq), wave, angle, m, q("qp"), q("qs"), depth)
        return list(zip(freq, np.abs(h).tolist(), np.abs(v).tolist()))

    return _over_profiles(profiles, "freq double, horizontal double, vertical double", lambda own: _turned([one(x or []) for x in own.to_pylist()], 3))
