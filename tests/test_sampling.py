"""Cutting polygons into triangles, and points drawn from them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.operators import sampling

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
HOLE, SECOND = [(2, 2), (2, 4), (4, 4), (4, 2)], [(6, 5), (8, 5), (8, 8), (6, 8)]
COMB = [(0, 0), (9, 0), (9, 5), (8, 1), (7, 5), (6, 1), (5, 5), (4, 1), (3, 5), (2, 1), (1, 5)]
PLANE = "id string, parts array<array<array<struct<x:double,y:double>>>>, n int"
SPHERE = PLANE.replace("x:", "lon:").replace("y:", "lat:")


def floats(x):
    return [floats(y) for y in x] if isinstance(x, list) else x and tuple(map(float, x))


def area(tri):
    return sum(abs(sampling._turn(*t)) / 2 for t in tri)


def inside(ring, x, y):
    hits = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        hits ^= (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0)
    return hits


@pytest.mark.parametrize("rings", [[SQUARE], [SQUARE[::-1] + SQUARE[-1:]], [SQUARE, HOLE], [SQUARE, HOLE[::-1], SECOND], [SQUARE, HOLE, [(5, 2), (6, 2), (6, 4), (5, 4)], SECOND], [COMB], [SQUARE + [(0, 5), (0, 2)], HOLE], [SQUARE, [(1, 1), (2, 2)]]])
def test_areas(rings):
    want = abs(sampling._area(np.array(rings[0], float))) - sum(abs(sampling._area(np.array(r, float))) for r in rings[1:] if len(r) > 2)
    tri = sampling.triangles(rings)
    assert area(tri) == pytest.approx(want)
    for middle in tri.mean(axis=1):
        assert inside(rings[0], *middle) and not any(inside(r, *middle) for r in rings[1:])


def test_random_stars():
    rng = np.random.default_rng(4)
    for _ in range(60):
        angle = np.sort(rng.random(rng.integers(5, 40))) * 2 * math.pi
        if np.diff(np.append(angle, angle[0] + 2 * math.pi)).max() > 3:
            continue
        radius = rng.uniform(2, 9, len(angle))
        star = np.c_[radius * np.cos(angle), radius * np.sin(angle)]
        hole = 0.2 * star
        assert area(sampling.triangles([star, hole])) == pytest.approx(0.96 * abs(sampling._area(star)))


def test_nothing_to_cut():
    assert len(sampling.triangles([])) == len(sampling.triangles([[]])) == len(sampling.triangles([[(0, 0), (1, 1)]])) == len(sampling.triangles([[(0, 0), (1, 1), (2, 2)]])) == 0
    with pytest.raises(ValueError, match="finite"):
        sampling.triangles([[(0, 0), (1, float("nan")), (2, 2)]])
    with pytest.raises(ValueError, match="outside"):
        sampling.triangles([SQUARE, [(20, 1), (21, 1), (21, 2)]])


def test_draws(spark):
    two = [[SQUARE, HOLE], [[(20, 0), (24, 0), (24, 8), (20, 8)]]]
    rows = [("a", two, 20000), ("b", [[SQUARE]], 7), ("c", [], 5), ("d", None, 5), ("e", [[SQUARE]], 0), ("f", [[SQUARE]], None)]
    frame = spark.createDataFrame([(i, floats(p), n) for i, p, n in rows], PLANE).withColumn("name", F.lit(1)).withColumn("flat", F.lit(2))
    got = sampling.in_plane(frame, seed=3, block=1000).collect()
    count = {i: sorted(p.k for p in got if p.id == i) for i in "abcdef"}
    assert count == {"a": list(range(20000)), "b": list(range(7)), "c": [], "d": [], "e": [], "f": []}
    xy = np.array([(p.x, p.y) for p in got if p.id == "a"])
    assert not any(inside(HOLE, x, y) for x, y in xy) and all(inside(SQUARE, x, y) or inside(two[1][0], x, y) for x, y in xy)
    # shares of strips follow their areas: 4 standard deviations
    for low, high, part in ((0, 2, 20), (2, 4, 16), (4, 10, 60), (20, 24, 32)):
        p = part / 128
        assert abs(((xy[:, 0] >= low) & (xy[:, 0] < high)).sum() - 20000 * p) < 4 * math.sqrt(20000 * p * (1 - p))
    again = sampling.in_plane(frame.where("id = 'a'").repartition(3), seed=3, block=1000).collect()
    assert {(p.k, p.x, p.y) for p in again} == {(p.k, p.x, p.y) for p in got if p.id == "a"}
    assert {(p.x, p.y) for p in sampling.in_plane(frame.where("id = 'b'"), seed=4).collect()}.isdisjoint({(p.x, p.y) for p in got if p.id == "b"})
    assert sampling.in_plane(frame.limit(0)).count() == 0


def test_null_ids_are_drawn(spark):
    frame = spark.createDataFrame([(None, floats([[SQUARE], None, [None]]), 3)], PLANE)
    assert [(p.id, p.k) for p in sampling.in_plane(frame).orderBy("k").collect()] == [(None, 0), (None, 1), (None, 2)]


def test_even_on_the_sphere(spark):
    band = [[[(0, 0), (20, 0), (20, 60), (0, 60)]]]
    lat = np.array([p.lat for p in sampling.on_sphere(spark.createDataFrame([("a", floats(band), 30000)], SPHERE), seed=1).collect()])
    # in the projection the sides are straight, so widths fall evenly from 20 to 10
    width = lambda y: 20 * y - y * y / 12
    p = width(30) / width(60)
    assert abs((lat < 30).sum() - 30000 * p) < 4 * math.sqrt(30000 * p * (1 - p)) and lat.min() >= 0 and lat.max() <= 60


def test_large_and_missing_integer_ids(spark):
    frame = spark.createDataFrame([(2**62 + 1, floats([[SQUARE]]), 2), (None, floats([[COMB]]), 1)], PLANE.replace("id string", "id bigint"))
    assert sorted((p.id or 0) for p in sampling.in_plane(frame).collect()) == [0, 2**62 + 1, 2**62 + 1]
