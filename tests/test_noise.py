import numpy as np
import pytest

from lithoscope.operators import noise


def test_mean_ratio_meets_brute_force(spark):
    rng = np.random.default_rng(3)
    signals = {"a": rng.normal(size=(2, 75)), "b": rng.normal(size=(2, 32)), "short": rng.normal(size=(2, 9))}
    samples = spark.createDataFrame([(s, i, float(x[0, i]), float(x[1, i])) for s, x in signals.items() for i in range(x.shape[1])], "sid string, i long, top double, base double")
    got = {(r.sid, r.k): r for r in noise.mean_ratio(samples, 0.01, 16, 8, taper=3).collect()}
    weights = np.ones(16)
    weights[[0, 15]], weights[[1, 14]], weights[[2, 13]] = 0, 0.25, 0.75
    expected = 0
    for s, x in signals.items():
        logs = []
        for begin in range(0, x.shape[1] - 15, 8):
            top, base = (np.array([sum(v * np.exp(-2j * np.pi * k * n / 16) for n, v in enumerate(y[begin : begin + 16] * weights)) for k in range(9)]) for y in x)
            cross = top * base.conj()
            cross[[0, 8]] = cross[[0, 8]].real  # exactly real there
            logs.append(np.log(cross / (abs(base) ** 2 + 1e-6 * max(abs(base) ** 2))))
        for k in range(9 if logs else 0):
            mean, spread = np.mean(logs, axis=0)[k], np.exp(np.std(logs, axis=0)[k])
            row, expected = got[s, k], expected + 1
            assert row.windows == len(logs) and row.freq == pytest.approx(k / 0.16)
            assert (row.amplitude, row.spread) == pytest.approx((np.exp(mean.real), spread), rel=1e-6)
            assert row.phase == pytest.approx(mean.imag, abs=1e-6)
    assert len(got) == expected == 18


def test_signals_must_be_synchronous(spark):
    samples = spark.createDataFrame([("a", i, 1.0, None if i == 5 else 1.0) for i in range(16)], "sid string, i long, top double, base double")
    with pytest.raises(Exception, match="synchronous"):
        noise.mean_ratio(samples, 0.01, 8, 8).collect()


@pytest.mark.parametrize("method", ["energy", "cross", "phase"])
def test_directions(spark, method):
    rng = np.random.default_rng(4)
    x = rng.normal(size=20) + 1j * rng.normal(size=20)
    y = 0.5 * x + 0.1 * rng.normal(size=20)
    rows = spark.createDataFrame([("s", k, float(a.real), float(a.imag), float(b.real), float(b.imag)) for k, (a, b) in enumerate(zip(x, y))], "sid string, k int, xr double, xi double, yr double, yi double")
    theta = {"energy": 0.5 * np.arctan2(2 * (x * y.conj()).sum().real, (abs(x) ** 2 - abs(y) ** 2).sum()), "cross": np.angle((x * y.conj()).sum()), "phase": np.arctan2(y.imag.sum(), x.imag.sum())}[method]
    got = sorted(noise.combined_directions(rows, method).collect(), key=lambda r: r.k)
    assert got[0].theta == pytest.approx(theta)
    assert np.allclose([complex(r.re, r.im) for r in got], x * np.cos(theta) + y * np.sin(theta))
