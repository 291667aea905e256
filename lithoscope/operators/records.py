"""Whole-record signal operators: a row is a record (sid, delta, data) and a kernel turns its samples into others.

Kernels are numpy functions on one record.  ``apply`` runs one over a frame in
Arrow batches; records are independent, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_samples(samples: DataFrame, delta: float) -> DataFrame:
    """Records from long rows (sid, i, v)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"].cast("double"))
    return samples.groupBy("sid").agg(F.lit(delta).alias("delta"), ordered.alias("data"))


def apply(records: DataFrame, kernel: Callable[[np.ndarray, float], dict[str, np.ndarray | float]], **outputs: str) -> DataFrame:
    """sid, delta and what ``kernel(data, delta)`` gives; ``outputs``: Spark types (double, long or array<double>) by name."""
    kinds = {"double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kernel(np.array(x.as_py() or (), float), d.as_py()) for x, d in zip(batch.column(2), batch.column(1))]
            columns = [pa.array([m[name] for m in made], kinds[kind]) for name, kind in outputs.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["sid", "delta", *outputs])

    rows = records.select(F.col("sid").cast("string"), F.col("delta").cast("double"), F.col("data").cast("array<double>"))
    return rows.mapInArrow(run, ", ".join(["sid string", "delta double", *(f"{n} {k}" for n, k in outputs.items())]))


# spectra


def spectrum(x: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided frequencies and transform, scaled by the interval."""
    return np.fft.rfftfreq(len(x), delta), np.fft.rfft(x) * delta


def butterworth_gain(freq: np.ndarray, corner: float, order: int, highpass: bool) -> np.ndarray:
    with np.errstate(divide="ignore"):
        ratio = np.where(freq > 0, corner / np.where(freq > 0, freq, 1), np.inf) if highpass else freq / corner
    return 1 / (1 + ratio ** (2 * order))


def bandpass(x: np.ndarray, delta: float, highpass: float | None = None, lowpass: float | None = None, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth filter: the squared gain, as a filter run forth and back has it; padded by its odd extension."""
    n = len(x)
    if n < 2:
        return x
    pad = min(n - 1, 3 * order * 10)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    freq, gain = np.fft.rfftfreq(len(wide), delta), 1.0
    for corner, high in ((highpass, True), (lowpass, False)):
        if corner is not None:
            if not 0 < corner < 0.5 / delta:
                raise ValueError("corner frequency outside the band")
            gain = gain * butterworth_gain(freq, corner, order, high)
    return np.fft.irfft(np.fft.rfft(wide) * gain, len(wide))[pad : pad + n]


def analytic(x: np.ndarray) -> np.ndarray:
    """Signal with its Hilbert transform as imaginary part."""
    n = len(x)
    weight = np.zeros(n)
    weight[0], weight[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0 and n:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * weight)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(x))


def instantaneous_frequency(x: np.ndarray, delta: float) -> np.ndarray:
    return np.gradient(np.unwrap(np.angle(analytic(x))), delta) / (2 * math.pi)


def instantaneous_phase(x: np.ndarray) -> np.ndarray:
    """Phase of the analytic signal in radians, without jumps."""
    return np.unwrap(np.angle(analytic(x)))


def from_spectrum(values: np.ndarray, delta: float, n: int) -> np.ndarray:
    """The ``n`` samples whose ``spectrum`` has these values."""
    return np.fft.irfft(np.asarray(values) / delta, n)


def zero_padded(x: np.ndarray, delta: float, seconds: float | None = None) -> np.ndarray:
    """Zeros after the samples, as long as these unless ``seconds`` (a whole number of samples) says otherwise."""
    count = len(x) if seconds is None else round(seconds / delta)
    if count < 0 or seconds is not None and abs(count * delta - seconds) > 1e-6 * delta:
        raise ValueError("padding is not a whole number of samples")
    return np.concatenate([x, np.zeros(count)])


def convolved(x: np.ndarray, kernel: np.ndarray, mode: str = "full") -> np.ndarray:
    """Linear convolution by transforms: all of it, the middle as long as ``x`` (same), or where both overlap wholly (valid); nothing with nothing."""
    n, m = len(x), len(kernel)
    if not n or not m:
        return np.zeros(0)
    whole = n + m - 1
    wide = 1 << (whole - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, wide) * np.fft.rfft(kernel, wide), wide)[:whole] if wide > 1 else np.asarray(x) * np.asarray(kernel)
    length = {"full": whole, "same": n, "valid": abs(n - m) + 1}[mode]
    return full[(whole - length) // 2 :][:length]


def correlated(x: np.ndarray, other: np.ndarray, mode: str = "full") -> np.ndarray:
    """Cross-correlation; of the full one, entry k is the lag k - (len(other) - 1)."""
    return convolved(x, np.asarray(other)[::-1], mode)


def shifted(x: np.ndarray, delta: float, seconds: float) -> np.ndarray:
    """Delay by a phase ramp; zeros come in."""
    pad = math.ceil(abs(seconds) / delta)
    wide = np.concatenate([np.zeros(pad), x, np.zeros(pad)])
    ramp = np.exp(-2j * math.pi * np.fft.rfftfreq(len(wide), delta) * seconds)
    return np.fft.irfft(np.fft.rfft(wide) * ramp, len(wide))[pad : pad + len(x)]


def resampled(x: np.ndarray, delta: float, new_delta: float, antialias: bool = True) -> np.ndarray:
    """Linear interpolation, after a low-pass at 0.9 of the new Nyquist frequency if samples get fewer."""
    if antialias and new_delta > delta:
        x = bandpass(x, delta, lowpass=0.45 / new_delta)
    t = np.arange(len(x)) * delta
    return np.interp(np.arange(int(t[-1] / new_delta + 1e-9) + 1) * new_delta, t, x)


def log_smoothed(freq: np.ndarray, amplitude: np.ndarray, sigma: float = 0.2, truncation: float = 3.0) -> np.ndarray:
    """Gaussian mean of log amplitudes over log frequency."""
    logs, out = np.log(freq), np.empty(len(freq))
    values = np.log(amplitude)
    for k, f in enumerate(logs):
        near = slice(*np.searchsorted(logs, [f - truncation * sigma, f + truncation * sigma + 1e-12]))
        w = np.exp(-0.5 * ((logs[near] - f) / sigma) ** 2)
        out[k] = (w * values[near]).sum() / w.sum()
    return np.exp(out)


# time and frequency


def short_time(x: np.ndarray, length: int, step: int) -> np.ndarray:
    """Transforms of Hann windows: frequencies by windows."""
    starts = np.arange(0, len(x) - length + 1, step)
    return np.fft.rfft(x[starts[:, None] + np.arange(length)] * np.hanning(length), axis=1).T


def wavelet(x: np.ndarray, delta: float, freq: np.ndarray, omega0: float = 6.0) -> np.ndarray:
    """Morlet wavelet transform: frequencies by samples."""
    n = 1 << (2 * len(x) - 1).bit_length()
    omega, fx = 2 * math.pi * np.fft.fftfreq(n, delta), np.fft.fft(x, n)
    scale = omega0 / (2 * math.pi * np.asarray(freq))
    psi = np.sqrt(scale / delta)[:, None] * math.pi**-0.25 * np.exp(-0.5 * (scale[:, None] * omega - omega0) ** 2) * (omega > 0)
    return np.fft.ifft(fx * psi, axis=1)[:, : len(x)]


def stockwell(x: np.ndarray) -> np.ndarray:
    """S transform: frequencies (from zero up to Nyquist) by samples."""
    n, fx = len(x), np.fft.fft(x)
    out = np.empty((n // 2 + 1, n), complex)
    out[0] = x.mean()
    k = np.fft.fftfreq(n) * n
    for f in range(1, n // 2 + 1):
        out[f] = np.fft.ifft(np.roll(fx, -f) * np.exp(-2 * math.pi**2 * k**2 / f**2))
    return out


def frequency_wavenumber(matrix: np.ndarray) -> np.ndarray:
    """Channels by samples to wavenumbers (centred) by frequencies."""
    return np.fft.fftshift(np.fft.fft(np.fft.rfft(matrix, axis=1), axis=0), axes=0)


# oscillators


def newmark(acceleration: np.ndarray, delta: float, period: float, damping: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Relative displacement and velocity and total acceleration of an oscillator (constant average acceleration)."""
    w = 2 * math.pi / period
    c, k = 2 * damping * w, w * w
    keff = k + 2 * c / delta + 4 / delta**2
    d, v = np.zeros(len(acceleration)), np.zeros(len(acceleration))
    a = -acceleration[0] if len(acceleration) else 0.0
    for i in range(len(acceleration) - 1):
        push = -acceleration[i + 1] + d[i] * (4 / delta**2 + 2 * c / delta) + v[i] * (4 / delta + c) + a
        d[i + 1] = push / keff
        v[i + 1] = 2 * (d[i + 1] - d[i]) / delta - v[i]
        a = 4 * (d[i + 1] - d[i] - v[i] * delta) / delta**2 - a
    return d, v, -c * v - k * d


def response_spectrum(acceleration: np.ndarray, delta: float, periods: np.ndarray, damping: float = 0.05) -> dict[str, np.ndarray]:
    """Peaks over periods: sd, sv, sa and the pseudo values psv, psa."""
    peaks = [[np.abs(x).max(initial=0) for x in newmark(acceleration, delta, p, damping)] for p in periods]
    sd, sv, sa = np.array(peaks).T
    w = 2 * math.pi / np.asarray(periods)
    return {"sd": sd, "sv": sv, "sa": sa, "psv": w * sd, "psa": w * w * sd}


# instruments


def pole_zero(freq: np.ndarray, scale: float, poles: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    s = 2j * math.pi * freq[:, None]
    return scale * np.prod(s - np.asarray(zeros, complex)[None], axis=1) / np.prod(s - np.asarray(poles, complex)[None], axis=1)


def convolved_response(x: np.ndarray, delta: float, gain: float, poles: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Instrument put in, as ``deconvolved`` takes it out."""
    n = 1 << (2 * len(x) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * pole_zero(np.fft.rfftfreq(n, delta), gain, poles, zeros), n)[: len(x)]


def fir_transfer(numerator: np.ndarray, denominator: np.ndarray, n: int) -> np.ndarray:
    """Ratio of two polynomials in the unit delay, at ``n`` frequencies from 0 to Nyquist."""
    delay = np.exp(-1j * np.linspace(0, math.pi, n))
    return np.polyval(np.asarray(numerator)[::-1], delay) / np.polyval(np.asarray(denominator)[::-1], delay)


def oscillator_transfer(omega: np.ndarray, own: float, damping: float = 0.05) -> np.ndarray:
    """Displacement of an oscillator of angular frequency ``own`` over the acceleration that drives it."""
    return 1 / (own**2 - omega**2 + 2j * damping * own * omega)


def deconvolved(x: np.ndarray, delta: float, gain: float, poles: np.ndarray, zeros: np.ndarray, water_db: float = 120.0) -> np.ndarray:
    """Instrument taken out; amplitudes below the (absolute) water level are held there."""
    n = 1 << (2 * len(x) - 1).bit_length()
    transfer = pole_zero(np.fft.rfftfreq(n, delta), gain, poles, zeros)
    size, level = np.abs(transfer), 10 ** (-water_db / 20)
    safe = np.where(size < level, level * np.where(size > 0, transfer / np.where(size > 0, size, 1), 1), transfer)
    return np.fft.irfft(np.fft.rfft(x, n) / safe, n)[: len(x)]


# soil columns


def sh_transfer(freq: np.ndarray, hl: np.ndarray, vs: np.ndarray, dn: np.ndarray, qs: np.ndarray | None = None, incidence: float = 0.0) -> np.ndarray:
    """Surface over outcrop motion of SH waves (complex): upgoing and downgoing waves carried from the surface down.

    ``incidence`` in radians, in the half-space; Haskell's recursion, all frequencies at once.
    """
    freq, vs = np.asarray(freq, float), np.asarray(vs, complex)
    if qs is not None:
        vs = vs * (1 + 0.5j / np.asarray(qs))
    mu, slow = np.asarray(dn) * vs**2, math.sin(incidence) / vs[-1]
    eta = np.sqrt(1 / vs**2 - slow**2)
    up, down = np.ones(len(freq), complex), np.ones(len(freq), complex)
    for k in range(len(vs) - 1):
        phase = np.exp(2j * math.pi * freq * eta[k] * hl[k])
        ratio = mu[k] * eta[k] / (mu[k + 1] * eta[k + 1])
        up, down = 0.5 * ((1 + ratio) * up * phase + (1 - ratio) * down / phase), 0.5 * ((1 - ratio) * up * phase + (1 + ratio) * down / phase)
    return 1 / up


def love_dispersion(freq: np.ndarray, hl: np.ndarray, vs: np.ndarray, dn: np.ndarray, modes: int = 1, n: int = 500) -> np.ndarray:
    """Phase velocities (frequencies by modes, nan beyond a mode's cut-off) from sign changes of the surface-stress function."""
    vs, out = np.asarray(vs, float), np.full((len(freq), modes), np.nan)

    def stress(c: np.ndarray, f: float) -> np.ndarray:
        w = 2 * math.pi * f
        u, t = np.ones_like(c), -(np.asarray(dn)[-1] * vs[-1] ** 2) * np.sqrt(np.maximum(0, 1 / c**2 - 1 / vs[-1] ** 2)) * w
        for k in range(len(vs) - 2, -1, -1):
            mu, e = dn[k] * vs[k] ** 2, np.sqrt((1 / vs[k] ** 2 - 1 / c**2).astype(complex)) * w
            cos, sinc = np.cos(e * hl[k]).real, np.where(np.abs(e) > 0, np.sin(e * hl[k]) / np.where(np.abs(e) > 0, e, 1), hl[k]).real
            u, t = u * cos - t * sinc / mu, u * mu * (e * e).real * sinc + t * cos
        return t

    for i, f in enumerate(freq):
        c = np.linspace(vs[:-1].min() * 1.0001, vs[-1] * 0.9999, n)
        values = stress(c, f)
        for m, k in enumerate(np.flatnonzero(values[:-1] * values[1:] < 0)[:modes]):
            a, b = c[k], c[k + 1]
            for _ in range(50):
                mid = (a + b) / 2
                same = stress(np.array([a]), f)[0] * stress(np.array([mid]), f)[0] > 0
                a, b = (mid, b) if same else (a, mid)
            out[i, m] = (a + b) / 2
    return out
