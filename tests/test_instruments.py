"""Responses of stages against plain complex arithmetic."""

import cmath
import math

import pytest

from lithoscope.operators import instruments

ROOTS = "array<struct<Real:double,Imaginary:double>>"
SCHEMA = f"sid string, start timestamp_ntz, end timestamp_ntz, stage int, gain double, scale double, poles {ROOTS}, zeros {ROOTS}, kind string, numerators array<double>, denominators array<double>, rate double"


def stage(sid, number, gain=None, scale=None, poles=None, zeros=None, kind=None, top=None, bottom=None, rate=None):
    pair = lambda c: c and [(complex(x).real, complex(x).imag) for x in c]
    return (sid, None, None, number, gain, scale, pair(poles), pair(zeros), kind, top, bottom, rate)


def test_channels(spark):
    poles, zeros, freqs = [-0.5 + 1j, -0.5 - 1j, -30.0], [0j, 0j, -4 + 0j], [0.0, 0.1, 1.0, 7.5]
    rows = [
        stage("a", 0, 1e12),
        stage("a", 1, -1500.0, 6.0, poles, zeros, "paz"),
        stage("a", 2, kind="fir", top=[0.1, 0.2, 0.4, 0.2, 0.1], rate=40.0),
        stage("a", 3, 2.0, kind="coefficients", top=[1.0, 0.5], bottom=[1.0, -0.25], rate=20.0),
        stage("a", 4, kind="polynomial", top=[3.0, -7.0, 0.5], bottom=[]),
        stage("b", 1, 5.0),
        stage("c", 1, kind="fir", top=[1.0]),
        stage("c", 2, 2.0),
        stage("d", 1, kind="paz", poles=[0j]),
    ]
    got = {(x.sid, x.freq): x for x in instruments.channel_response(spark.createDataFrame(rows, SCHEMA), freqs + freqs).collect()}
    assert len(got) == 4 * len(freqs)
    for f in freqs:
        s = 2j * math.pi * f
        step = lambda rate: cmath.exp(-s / rate)
        power = lambda c, z: sum(v * z**k for k, v in enumerate(c))
        want = -1500 * 6 * math.prod([s - z for z in zeros]) / math.prod([s - p for p in poles])
        want *= power([0.1, 0.2, 0.4, 0.2, 0.1], step(40)) * 2 * power([1, 0.5], step(20)) / power([1, -0.25], step(20)) * power([3, -7, 0.5], s)
        x = got["a", f]
        assert x.amplitude == pytest.approx(abs(want), rel=1e-9, abs=1e-12) and -math.pi < x.phase <= math.pi
        if f:
            assert cmath.rect(1, x.phase) == pytest.approx(want / abs(want), abs=1e-9)
        assert (got["b", f].amplitude, got["b", f].phase) == (5.0, 0.0)
        assert got["c", f].amplitude is None and got["c", f].phase is None
    assert got["d", 0.0].amplitude == pytest.approx(1e12)


def test_nothing(spark):
    frame = spark.createDataFrame([stage("b", 1, 5.0)], SCHEMA)
    assert instruments.channel_response(frame, []).count() == 0
    assert instruments.channel_response(frame.limit(0), [1.0]).count() == 0
