import math

import numpy as np

from lithoscope.operators import records


def test_filter_keeps_the_band():
    t = np.arange(4000) * 0.01
    x = np.sin(2 * math.pi * 1 * t) + np.sin(2 * math.pi * 20 * t)
    low = records.bandpass(x, 0.01, lowpass=5.0)
    assert np.abs(low - np.sin(2 * math.pi * t))[500:-500].max() < 0.01
    high = records.bandpass(x, 0.01, highpass=5.0)
    assert np.abs(high - np.sin(2 * math.pi * 20 * t))[500:-500].max() < 0.01


def test_oscillator_meets_its_closed_form():
    delta, period, zeta = 0.001, 0.5, 0.05
    a = np.ones(4000)
    d, _, _ = records.newmark(a, delta, period, zeta)
    w = 2 * math.pi / period
    wd, t = w * math.sqrt(1 - zeta**2), np.arange(4000) * delta
    exact = -(1 - np.exp(-zeta * w * t) * (np.cos(wd * t) + zeta * w / wd * np.sin(wd * t))) / w**2
    assert np.abs(d - exact).max() < 1e-4 / w**2 * 20


def test_transforms():
    t = np.arange(512) * 0.01
    x = np.sin(2 * math.pi * 5 * t)
    assert abs(np.median(records.instantaneous_frequency(x, 0.01)) - 5) < 0.05
    assert abs(np.median(records.envelope(x)) - 1) < 0.02
    power = np.abs(records.wavelet(x, 0.01, np.array([2.0, 5.0, 12.0])))[:, 256]
    assert power.argmax() == 1
    assert np.abs(records.stockwell(x)).mean(axis=1).argmax() == round(5 * 512 * 0.01)
    moved = records.shifted(x, 0.01, 0.2)
    assert np.abs(moved[100:400] - x[80:380]).max() < 0.05
    assert len(records.resampled(x, 0.01, 0.02)) == 256
    assert records.frequency_wavenumber(np.ones((4, 8))).shape == (4, 5)
    f, a = np.arange(1, 50.0), np.full(49, 3.0)
    assert np.allclose(records.log_smoothed(f, a), 3)


def test_instrument_round_trip():
    delta = 0.01
    x = np.sin(np.arange(600) * 0.2) * np.hanning(600)
    poles, zeros = np.array([-3 + 3j, -3 - 3j]), np.array([-0.5])
    n = 1 << (2 * len(x) - 1).bit_length()
    recorded = np.fft.irfft(np.fft.rfft(x, n) * records.pole_zero(np.fft.rfftfreq(n, delta), 2.0, poles, zeros), n)
    back = np.fft.irfft(np.fft.rfft(recorded) / records.pole_zero(np.fft.rfftfreq(n, delta), 2.0, poles, zeros), n)[:600]
    assert np.allclose(back, x, atol=1e-6)
    assert np.isfinite(records.deconvolved(recorded[:600], delta, 2.0, poles, zeros)).all()


def test_soil_columns():
    # one layer without damping: 1 / |cos(w h / v) + i a sin(w h / v)|
    f, h, v, r, a = np.array([0.5, 1.0, 2.0, 3.3]), 100.0, 200.0, 1900.0, 200 * 1900 / (1200 * 2500)
    got = np.abs(records.sh_transfer(f, np.array([h, 0]), np.array([v, 1200.0]), np.array([r, 2500.0])))
    k = 2 * math.pi * f * h / v
    assert np.allclose(got, 1 / np.abs(np.cos(k) + 1j * a * np.sin(k)))
    # Love waves over a half-space: tan(k h) = rigidity times decay over rigidity times slowness
    f, hl, vs, dn = np.array([0.5, 1.0, 4.0]), np.array([100.0, 0.0]), np.array([300.0, 1000.0]), np.array([1800.0, 2200.0])
    c = records.love_dispersion(f, hl, vs, dn)[:, 0]
    e, g = np.sqrt(1 / 300**2 - 1 / c**2), np.sqrt(1 / c**2 - 1 / 1000**2)
    assert np.allclose(np.tan(2 * math.pi * f * 100 * e), dn[1] * vs[1] ** 2 * g / (dn[0] * vs[0] ** 2 * e), rtol=1e-4)
