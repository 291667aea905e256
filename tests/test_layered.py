from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import layered as lw

CRUST = lw.Layers(np.array([5.0, 10.0, 0.0]), np.array([5.0, 6.2, 8.0]), np.array([2.8, 3.5, 4.6]), np.array([2.4, 2.7, 3.3]))
PERIODS = [2.0, 5.0, 10.0, 20.0, 40.0]


def matrix(c, vp, vs, dn):
    """The system of motion and stress by depth times wave number."""
    mu = dn * vs**2
    lam = dn * vp**2 - 2 * mu
    e = 1 / (lam + 2 * mu)
    return np.array([[0, 1, 1 / mu, 0], [-lam * e, 0, 0, e], [4 * mu * (lam + mu) * e - dn * c * c, 0, 0, lam * e], [0, -dn * c * c, -1, 0]])


def determinant(c, period, m):
    """Of the two stresses of the two waves that decay below, carried up by plain matrix exponentials."""
    values, vectors = np.linalg.eig(matrix(c, m.vp[-1], m.vs[-1], m.dn[-1]))
    order = np.argsort(values.real)[:2]
    y = vectors[:, order].real
    # ordered and signed alike for all velocities
    y = y / y[0] if abs(y[0]).min() > 1e-9 else y
    y = y[:, np.argsort(values.real[order])]
    for j in range(len(m.vs) - 2, -1, -1):
        w, v = np.linalg.eig(matrix(c, m.vp[j], m.vs[j], m.dn[j]).astype(complex))
        y = (v @ np.diag(np.exp(-w * m.hl[j] * 2 * np.pi / (period * c))) @ np.linalg.inv(v) @ y).real
    return y[2, 0] * y[3, 1] - y[2, 1] * y[3, 0]


def test_rayleigh_waves_of_a_half_space():
    """0.9194 of the shear velocity where both elastic constants are equal, in a half-space cut into layers too."""
    v = 3.0
    m = lw.Layers(np.array([1.0, 3.0, 0.0]), np.full(3, v * 3**0.5), np.full(3, v), np.full(3, 2.0))
    found = lw.phase_velocity("rayleigh", [0.5, 3.0, 50.0], m) / v
    assert found == pytest.approx(np.sqrt(2 - 2 / 3**0.5), abs=1e-9)
    assert lw.group_velocity("rayleigh", [3.0], m)[0, 0] / v == pytest.approx(np.sqrt(2 - 2 / 3**0.5), abs=1e-8)
    assert np.isnan(lw.phase_velocity("love", [1.0], m)).all()


def test_rayleigh_roots_are_roots_of_the_plain_determinant():
    found = lw.phase_velocity("rayleigh", PERIODS, CRUST, 2)
    assert not np.isnan(found[:, 0]).any() and (np.diff(found[:, 0]) > 0).all() and found[:, 0].min() > 2.8 * 0.8
    for t, roots in zip(PERIODS, found):
        for c in roots[~np.isnan(roots)]:
            assert determinant(c * (1 - 1e-6), t, CRUST) * determinant(c * (1 + 1e-6), t, CRUST) < 0
    # and no other root lies below the fundamental one
    for t, c in zip(PERIODS, found[:, 0]):
        signs = np.sign([determinant(x, t, CRUST) for x in np.linspace(2.3, c * 0.9999, 200)])
        assert (signs == signs[0]).all()


def test_short_periods_see_the_top_and_do_not_overflow():
    top = lw.Layers(np.array([5.0, 0.0]), np.array([5.0, 8.0]), np.array([2.8, 4.6]), np.array([2.4, 3.3]))
    alone = replace(top, hl=np.array([0.0]), vp=top.vp[:1], vs=top.vs[:1], dn=top.dn[:1])
    assert lw.phase_velocity("rayleigh", [0.01], top)[0, 0] == pytest.approx(lw.phase_velocity("rayleigh", [0.01], alone)[0, 0], abs=1e-6)


def test_love_waves_meet_the_closed_form():
    m = lw.Layers(np.array([10.0, 0.0]), np.array([6.0, 8.0]), np.array([3.0, 4.5]), np.array([2.7, 3.3]))
    for t, roots in zip([3.0, 8.0, 20.0], lw.phase_velocity("love", [3.0, 8.0, 20.0], m, 3)):
        for mode, c in enumerate(roots):
            cut_off = 10 * 2 / max(mode, 1e-9) * np.sqrt(1 / 3.0**2 - 1 / 4.5**2)
            assert np.isnan(c) == (mode > 0 and t > cut_off)
            if not np.isnan(c):
                k, inner, outer = 2 * np.pi / t / c, np.sqrt((c / 3) ** 2 - 1), np.sqrt(1 - (c / 4.5) ** 2)
                assert k * inner * 10 - mode * np.pi == pytest.approx(np.arctan(3.3 * 4.5**2 * outer / (2.7 * 9 * inner)), abs=1e-8)


@pytest.mark.parametrize("wave", ["rayleigh", "love"])
def test_kernels_are_differences_of_velocities(wave):
    got = {g: lw.kernels(wave, [5.0, 20.0], CRUST, 1, g) for g in (False, True)}
    for i, name in enumerate(lw.PARAMETERS):
        for j in range(3):
            def at(sign, velocity, name=name, j=j):
                value = getattr(CRUST, name).copy()
                value[j] *= 1 + sign * 1e-3
                return velocity(wave, [5.0, 20.0], replace(CRUST, **{name: value}))

            step = 2e-3 * getattr(CRUST, name)[j]
            for g, velocity in ((False, lw.phase_velocity), (True, lw.group_velocity)):
                want = (at(1, velocity) - at(-1, velocity)) / step if step else np.zeros((2, 1))
                assert got[g][:, :, i, j] == pytest.approx(want, abs=2e-5)
    # a profile with all velocities and thicknesses scaled alike has its velocities scaled alike at the same period
    c, k = lw.phase_velocity(wave, [5.0, 20.0], CRUST)[:, 0], got[False][:, 0]
    assert (k[:, 0] * CRUST.hl + k[:, 1] * CRUST.vp + k[:, 2] * CRUST.vs).sum(-1) == pytest.approx(c, abs=1e-5)
    assert k[:, 3] @ CRUST.dn == pytest.approx(0, abs=1e-5)


def test_waves_at_a_free_surface_meet_the_closed_form():
    m = lw.Layers(np.array([0.3, 0.0]), np.array([6.0, 6.0]), np.array([3.2, 3.2]), np.array([2.7, 2.7]))
    a, b = 6.0, 3.2
    for wave, v in (("p", a), ("sv", b)):
        for angle in (0.0, 0.2, 0.45):
            p = np.sin(angle) / v
            x, y = np.sqrt(1 / a**2 - p * p), np.sqrt(1 / b**2 - p * p)
            d = (1 / b**2 - 2 * p * p) ** 2 + 4 * p * p * x * y
            want = (4 * a / b**2 * p * x * y / d, 2 * a / b**2 * x * (1 / b**2 - 2 * p * p) / d) if wave == "p" else (2 / b * y * (1 / b**2 - 2 * p * p) / d, 4 / b * p * x * y / d)
            h, vert = lw.incident(np.array([0.3, 2.0]), wave, angle, m)
            assert np.abs(h) == pytest.approx(want[0], abs=1e-9) and np.abs(vert) == pytest.approx(want[1], abs=1e-9)


#: Frequency and half the amplitude, of published test cases.
GOLDEN = {
    ("two", 0.0): [(0.1, 1.0503), (0.5, 4.8672), (1.0, 0.9687), (2.5, 1.8548), (4.99, 0.6981), (9.0, 0.4129)],
    ("two", 100.0): [(0.1, 0.999), (0.5, 0.3827), (1.0, 0.9807), (2.5, 0.7473), (4.99, 0.9234), (9.0, 0.8991)],
    ("three", 0.0): [(0.1, 1.0028), (0.5, 1.0744), (1.0, 1.3465), (2.5, 2.5452), (4.99, 4.2285), (9.0, 1.1595)],
    ("three", 10.0): [(0.1, 1.0024), (0.5, 1.0612), (1.0, 1.2808), (2.5, 1.8025), (4.99, 0.332), (9.0, 1.115)],
    ("three", 60.0): [(0.1, 0.9997), (0.5, 0.9905), (1.0, 0.948), (2.5, 0.6598), (4.99, 0.4538), (9.0, 0.8561)],
}
SOILS = {"two": [(100.0, 200.0, 1900.0, 10.0), (0.0, 1200.0, 2500.0, 100.0)], "three": [(10.0, 200.0, 1900.0, 10.0), (50.0, 500.0, 2100.0, 20.0), (0.0, 1200.0, 2500.0, 100.0)]}


@pytest.mark.parametrize(("soil", "depth"), GOLDEN)
def test_sh_and_vertical_sv_waves_meet_published_rows(soil, depth):
    f, want = np.array(GOLDEN[soil, depth]).T
    hl, vs, dn, qs = np.array(SOILS[soil]).T
    assert np.abs(lw.sh_at_depth(f, hl, vs, dn, qs, depth)) / 2 == pytest.approx(want, abs=1e-4)
    h, vert = lw.incident(f, "sv", 0.0, lw.Layers(hl, vs * 2, vs, dn), qs * 2, qs, depth)
    assert np.abs(h) / 2 == pytest.approx(want, abs=1e-4) and np.abs(vert).max() < 1e-9


def test_motion_is_continuous_across_interfaces():
    hl, vs, dn, qs = np.array(SOILS["three"]).T
    m, f = lw.Layers(hl, vs * 2, vs, dn), np.array([1.0, 4.0])
    for wave in ("p", "sv"):
        above, below = (np.array(lw.incident(f, wave, 0.3, m, qs, qs, 10 + d)) for d in (-1e-9, 1e-9))
        assert above == pytest.approx(below, abs=1e-6)


def test_frames(spark):
    layer = "array<struct<hl:double,vs:double,dn:double,qs:double>>"
    rows = [("a", [(5.0, 2.8, 2.4, 10.0), (0.0, 4.6, 3.3, 50.0)]), (None, [(0.0, 3.0, 2.0, None)]), ("bad", [(5.0, None, 2.4, 1.0), (0.0, 4.6, 3.3, 1.0)]), ("empty", None)]
    profiles = spark.createDataFrame([(*r, 1) for r in rows], f"site string, layers {layer}, `a.b` int")
    got = lw.dispersion(profiles, [2.0, 8.0], modes=2)
    assert got.count() == 4 * 2 * 2 * 2 and got.where("site = 'bad' or site = 'empty'").where("phase is not null").count() == 0
    m = lw.Layers.of([dict(hl=5.0, vs=2.8, dn=2.4), dict(hl=0.0, vs=4.6, dn=3.3)], 3**0.5)
    for r in got.where("site = 'a'").collect():
        want = lw.phase_velocity(r.wave, [r.period], m, 2)[0, r.mode]
        assert (r.phase is None and np.isnan(want)) or r.phase == pytest.approx(want, abs=1e-12)
    slopes = lw.sensitivity(profiles, [2.0])
    assert slopes.where("site = 'a'").count() == 2 * 4 * 2 and slopes.where("site is null and wave = 'rayleigh' and parameter = 'vs'").first().slope > 0
    assert lw.response(profiles, [1.0], "p").where("site = 'a'").first().horizontal == pytest.approx(0, abs=1e-12)
    assert lw.response(profiles, [1.0], "sh").where(F.col("site").isNull()).first().horizontal == pytest.approx(2, abs=1e-9)
    assert lw.dispersion(profiles.limit(0), [1.0]).count() == 0


def soils(number, layers=6):
    """Profiles of soft soils, layers by profiles."""
    rng = np.random.default_rng(1)
    vs = rng.uniform(0.32, 0.35, (layers, number))
    return lw.Layers(rng.uniform(0.001, 0.05, vs.shape), vs * 3**0.5, vs, rng.uniform(1.8, 2.1, vs.shape))


@pytest.mark.parametrize("wave", ["rayleigh", "love"])
def test_few_velocities_are_tried_for_a_root(wave, monkeypatch):
    tried, plain = [], lw.WAVES[wave]
    monkeypatch.setitem(lw.WAVES, wave, lambda c, *more: (tried.append(c.size), plain(c, *more))[1])
    found = lw._every_phase(wave, np.array([0.1, 0.3, 1.0]), soils(50), 2, lw.STEPS)
    assert sum(tried) < 30 * found.size


def test_modes_just_below_the_half_space_are_found():
    m = lw.Layers(np.array([10.0, 0.0]), np.array([6.0, 8.0]), np.array([3.0, 4.5]), np.array([2.7, 3.3]))
    cut_off = 20 * np.sqrt(1 / 3.0**2 - 1 / 4.5**2)
    below, above = lw.phase_velocity("love", [cut_off * 0.999, cut_off * 1.001], m, 2)[:, 1]
    assert 4.4999 < below < 4.5 and np.isnan(above)


def test_modes_close_to_each_other_are_found():
    """A soft layer at the surface, and one of twice its thickness far below, guide Love waves alike."""
    m = lw.Layers(np.array([1.0, 10.0, 2.0, 0.0]), np.full(4, 3.5), np.array([1.0, 1.9, 1.0, 1.9]), np.full(4, 2.0))
    alone = lw.Layers(*(x[:2] for x in (m.hl, m.vp, m.vs, m.dn)))
    one, two = lw.phase_velocity("love", [1.0], m, 2)[0]
    assert one == pytest.approx(lw.phase_velocity("love", [1.0], alone)[0, 0], abs=1e-9) and two == pytest.approx(one, abs=1e-9)


@pytest.mark.parametrize("wave", ["rayleigh", "love"])
def test_counts_are_numbers_of_changes_of_sign(wave):
    """Thin, thick, stiff and soft layers; a half-space up to twice as fast as the slowest one."""
    rng, most = np.random.default_rng(2), 0
    for _ in range(60):
        n = rng.integers(2, 8)
        vs = 0.3 * rng.choice([1.9, 20.0]) ** rng.random(n)
        vs[-1] = vs[:-1].min() * rng.uniform(1.05, 2)
        m = lw.Layers(10 ** rng.uniform(-6, -1, n), vs * rng.uniform(1.3, 3, n), vs, rng.uniform(1, 3, n)).alone()
        c = np.linspace(vs.min() * (0.8 if wave == "rayleigh" else 1), vs[-1], 4000)
        f, below = lw._passed(wave, c, 10 ** rng.uniform(-1.5, 0), m)
        changes = np.cumsum(np.sign(f[1:]) != np.sign(f[:-1]))
        # two roots within one of these steps change the count, not the sign
        assert ((below[1:] - below[0] - changes) % 2 == 0).all() and (np.diff(below) >= 0).all()
        if (np.diff(below) < 2).all():
            assert (below[1:] - below[0] == changes).all()
        most = max(most, below[-1])
    assert most > 3


def test_modes_that_run_backwards_are_found():
    """On a base that is 20 times as fast, a count would fall with velocity."""
    vs = np.array([1.0, 20.0])
    m = lw.Layers(np.array([1.0, 0.0]), vs * 1.62, vs, np.array([1.0, 2.0]))
    c, periods = np.linspace(0.8, 20, 40001), np.linspace(0.4, 4, 80)
    fell = 0
    for t, found in zip(periods, lw.phase_velocity("rayleigh", periods, m, 6, 4000)):
        f, below = lw._passed("rayleigh", c, t, m.alone())
        roots = c[1:][np.sign(f[1:]) != np.sign(f[:-1])][:6]
        fell += (np.diff(below) < 0).any()
        assert found[: len(roots)] == pytest.approx(roots, abs=1e-3) and np.isnan(found[len(roots) :]).all()
    assert fell


def test_stiff_layers_keep_precision():
    """A slab on soft soil moves like the same slab in pieces, and as with more digits."""
    slab = lw.Layers(np.array([0.02, 0.3, 0.0]), np.array([4.0, 0.35, 0.4]), np.array([2.4, 0.15, 0.2]), np.array([2.4, 1.8, 1.9]))
    pieces = lw.Layers(*(np.concatenate([np.full(4, x[0] / q), x[1:]]) for x, q in ((slab.hl, 4), (slab.vp, 1), (slab.vs, 1), (slab.dn, 1))))
    more = lw.Layers(*(x.astype(np.longdouble) for x in (slab.hl, slab.vp, slab.vs, slab.dn)))
    found = lw.phase_velocity("rayleigh", [0.1, 0.5, 2.0], slab)
    assert found == pytest.approx(lw.phase_velocity("rayleigh", [0.1, 0.5, 2.0], pieces), rel=1e-11, nan_ok=True) and not np.isnan(found).all()
    assert found == pytest.approx(lw.phase_velocity("rayleigh", [0.1, 0.5, 2.0], more), rel=1e-11, nan_ok=True)


def test_profiles_of_columns():
    """As of rows: other numbers of layers, nulls, other kinds of numbers, and a part of a column."""
    kind = pa.list_(pa.struct([("hl", pa.decimal128(6, 2)), ("vs", pa.float32()), ("dn", pa.int32())]))
    rows = [[(9, 9, 9)], [(5, 2.5, 2), (None, 4.5, 3)], None, [(5, 2.5, 2), None], [], [(1, 2, 2), (3, 3, 3), (0, 4, 3)], [(-1, 2, 2), (3, 3, 3), (0, 4, 3)], [(None, 3, 2)], [(7, 3.5, 2), (1, 4.5, 3)]]
    column = pa.array([own and [x and dict(zip(("hl", "vs", "dn"), x)) for x in own] for own in rows], kind)
    got = {int(k): [x[:, i] for x in (m.hl, m.vs, m.vp, m.dn)] for at, m in lw._alike(column.slice(1), 2.0) for i, k in enumerate(at)}
    assert sorted(got) == [0, 4, 6, 7]
    for k, (hl, vs, vp, dn) in got.items():
        want = lw.Layers.of([dict(zip(("hl", "vs", "dn"), x)) for x in rows[k + 1]], 2.0)
        assert vs == pytest.approx(want.vs) and vp == pytest.approx(want.vp) and dn == pytest.approx(want.dn) and hl == pytest.approx(want.hl, nan_ok=True)


def test_a_count_is_not_trusted_where_it_is_lost_in_rounding():
    hl, vs = np.array([0.02, 0.5, 0.0]), np.array([600.0, 0.15, 0.2])
    m = lw.Layers(hl, vs * 2, vs, np.array([2.4, 1.8, 1.9]))
    c = np.minimum(0.12 * (0.2 / 0.12) ** (np.arange(401) / 400), 0.2)
    for t, found in zip([0.3, 1.0], lw.phase_velocity("rayleigh", [0.3, 1.0], m, 3)):
        f = lw.secular("rayleigh", c, t, m.alone())
        at = np.flatnonzero(f[:-1] * f[1:] < 0)[:3]
        assert len(at) == (~np.isnan(found)).sum() and ((c[at] <= found[: len(at)]) & (found[: len(at)] <= c[at + 1])).all()
