import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import records, recursive, waveform


def one_pass(machine, x):
    """The machine again, sample by sample."""
    state, out = machine.first * (x[0] if len(x) else 0), []
    for v in x:
        out.append(machine.c @ state + machine.d * v)
        state = machine.a @ state + machine.b * v
    return np.array(out)


def gain(machine, f, delta):
    z = np.exp(2j * math.pi * f * delta)
    return abs(machine.c[0] @ np.linalg.solve(z * np.eye(len(machine.a)) - machine.a, machine.b) + machine.d[0])


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_gains_are_butterworth(order):
    delta, warp = 0.01, lambda f: math.tan(math.pi * f * 0.01)
    for f in (0.5, 2.0, 7.0, 20.0, 45.0):
        low, high = recursive.butterworth(delta, lowpass=7.0, order=order), recursive.butterworth(delta, highpass=7.0, order=order)
        assert gain(low, f, delta) == pytest.approx(1 / math.sqrt(1 + (warp(f) / warp(7)) ** (2 * order)), rel=1e-9)
        assert gain(high, f, delta) == pytest.approx(1 / math.sqrt(1 + (warp(7) / warp(f)) ** (2 * order)), rel=1e-9)
        band = recursive.butterworth(delta, 2.0, 20.0, order)
        ratio = (warp(f) ** 2 - warp(2) * warp(20)) / (warp(f) * (warp(20) - warp(2)))
        assert gain(band, f, delta) == pytest.approx(1 / math.sqrt(1 + ratio ** (2 * order)), rel=1e-8)
        assert np.abs(np.linalg.eigvals(band.a)).max() < 1
    for bad in ({}, {"highpass": 60.0}, {"highpass": 5.0, "lowpass": 2.0}, {"lowpass": 0.0}, {"lowpass": 1.0, "order": 0}):
        with pytest.raises(ValueError):
            recursive.butterworth(delta, **{"order": order} | bad)


def test_oscillator_is_newmark():
    x = np.random.default_rng(1).normal(size=300)
    for period in (0.05, 0.5, 3.0):
        got, want = one_pass(recursive.oscillator(0.01, period), x), records.newmark(x, 0.01, period)
        for k in range(3):
            assert got[:, k] == pytest.approx(want[k], abs=1e-9 * np.abs(want[k]).max())


@pytest.mark.parametrize(("size", "fan"), [(8, 3), (16, 1000), (1024, 1000)])
def test_segments_are_one_pass(spark, monkeypatch, size, fan):
    """Over several levels of composed maps, with sources of every length."""
    monkeypatch.setattr(recursive, "FAN", fan)
    rng, machine = np.random.default_rng(2), recursive.butterworth(0.01, 1.0, 20.0, 4)
    records_ = {sid: rng.normal(size=n) for sid, n in (("one", 1), ("seven", 7), ("eight", 8), ("long", 250), (None, 20))}
    rows = [(sid, k, float(v), 1) for sid, x in records_.items() for k, v in enumerate(x)]
    rng.shuffle(rows)
    samples = spark.createDataFrame([(s, int(k), float(v), 1) for s, k, v, _ in rows], "sid string, i long, v double, `a.b` int").repartition(5)
    got = {}
    for r in recursive.filtered(samples, machine, size).collect():
        got.setdefault(r.sid, {})[r.k] = r.y
    peaks = {(r.sid, r.period): (r.sd, r.sv, r.sa) for r in recursive.response_spectrum(samples, 0.01, [0.1, 1.0], size=size).collect()}
    for sid, x in records_.items():
        want = one_pass(machine, x)[:, 0]
        assert [got[sid][k] for k in range(len(x))] == pytest.approx(want, abs=1e-9)
        for period in (0.1, 1.0):
            assert peaks[sid, period] == pytest.approx([np.abs(v).max() for v in records.newmark(x, 0.01, period)], abs=1e-9)
    assert len(got) == 5 and len(peaks) == 10
    assert recursive.filtered(samples.limit(0), machine, size).count() == 0


def test_gaps_and_nulls(spark):
    rows = [("a", 5, 1.0), ("a", 4000, None), ("a", 90_000, 2.0), ("a", 90_000, 1.5)]
    machine = recursive.butterworth(0.01, lowpass=10.0)
    got = recursive.filtered(spark.createDataFrame(rows, "sid string, i long, v double"), machine).orderBy("k").collect()
    assert [r.y for r in got] == pytest.approx(one_pass(machine, np.array([1.0, 0.0, 1.5, 2.0]))[:, 0], abs=1e-12)


def test_intensities_do_not_hang_on_order(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=500) * 200, 2)
    samples = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)] + [("single", 0, 3.0)], "sid string, i long, v double")
    area = lambda y: ((y[1:] + y[:-1]) / 2).sum() * 0.01
    for parts in (1, 4):
        own = samples.repartition(parts, F.rand(parts))
        values = [{r[0]: r[1] for r in f(own, 0.01).collect()} for f in (waveform.arias_intensity, waveform.cumulative_absolute_velocity, waveform.root_mean_square)]
        assert values[0]["s"] == pytest.approx(area(x * x) * math.pi / (2 * waveform.GRAVITY), rel=1e-9) and values[0]["single"] == 0
        assert values[1]["s"] == pytest.approx(area(np.abs(x)), rel=1e-9) and values[2]["s"] == pytest.approx(math.sqrt(area(x * x) / 4.99), rel=1e-9)
