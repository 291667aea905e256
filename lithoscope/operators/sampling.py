"""Points drawn evenly from polygons, in parallel and alike on every run.

A polygon with holes is cut into triangles by clipping ears, after each hole has
been bridged to its ring; a triangle is chosen by its area and a point in it by
two numbers.  Nothing is drawn and thrown away, so the count is exact.  Draws go in
blocks of bounded length that Spark deals to tasks, each with a generator of its
own seed (seed, id, block): a task that runs again draws the same points, and one
polygon with nearly all the draws is many blocks.

On the sphere polygons are drawn in the sinusoidal projection, which keeps areas;
edges are straight there.

``polygons``: id, parts (array of polygons, each an array of rings of (lon, lat)
structs or, in the plane, (x, y); the first ring is the outline, the others are
holes) and n, the points to draw.

Defined results: rings may be closed or open, either way round, and repeat points;
rings of fewer than three different points count as nothing.  Polygons that are
null, empty or without area, and a null n or one under 1, give no points.  Parts
that overlap are drawn from twice.  Ids may be of any type; rows with equal ids draw
the same points.  Coordinates that are null or not finite raise an error, as do
rings that cross themselves so that no ear is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo

BLOCK, AT_ONCE = 4096, 1 << 16


def _turn(p, q, r) -> float:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def _area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float(x @ np.roll(y, -1) - np.roll(x, -1) @ y) / 2


def cleaned(ring, left: bool) -> np.ndarray:
    """A ring without its closing and repeated points, its inside to the left or the right; empty if it has no area."""
    points = np.asarray(ring, float).reshape(-1, 2)
    if not np.isfinite(points).all():
        raise ValueError("a polygon's coordinates are null or not finite")
    if len(points):
        points = points[(points != np.roll(points, 1, axis=0)).any(axis=1)]
    area = _area(points) if len(points) > 2 else 0.0
    return points[:0] if area == 0 else points if (area > 0) == left else points[::-1]


def _bridged(outline: np.ndarray, hole: np.ndarray) -> np.ndarray:
    """One ring from an outline and a hole, joined by the bridge from the hole's rightmost point."""
    k = int(hole[:, 0].argmax())
    p, a, b = hole[k], outline, np.roll(outline, -1, axis=0)
    # the edge that a ray to the right meets first
    spans = ((a[:, 1] <= p[1]) & (b[:, 1] >= p[1])) & (a[:, 1] != b[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        met = np.where(spans, a[:, 0] + (p[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]), np.inf)
    met[met < p[0]] = np.inf
    edge = int(met.argmin())
    if not np.isfinite(met[edge]):
        raise ValueError("a hole lies outside its outline")
    m = edge if a[edge, 0] > b[edge, 0] else (edge + 1) % len(outline)
    corner, hit = outline[m], np.array([met[edge], p[1]])
    # a point of the outline inside the triangle of ray and edge would be in the way: the one least off the ray is taken
    three = np.array([p, hit, corner]) if _turn(p, hit, corner) > 0 else np.array([p, corner, hit])
    inside = np.ones(len(outline), bool)
    for i in range(3):
        s, t = three[i], three[(i + 1) % 3]
        inside &= (t[0] - s[0]) * (outline[:, 1] - s[1]) - (t[1] - s[1]) * (outline[:, 0] - s[0]) >= 0
    inside &= (outline != corner).any(axis=1) & (outline[:, 0] >= p[0])
    before, after = np.roll(outline, 1, axis=0), b
    reflex = (outline[:, 0] - before[:, 0]) * (after[:, 1] - outline[:, 1]) - (outline[:, 1] - before[:, 1]) * (after[:, 0] - outline[:, 0]) <= 0
    held = np.flatnonzero(inside & reflex)
    if len(held):
        off = np.abs(np.arctan2(outline[held, 1] - p[1], outline[held, 0] - p[0]))
        m = int(held[np.lexsort((np.hypot(*(outline[held] - p).T), off))[0]])
    around = np.concatenate([hole[k:], hole[: k + 1]])
    return np.concatenate([outline[: m + 1], around, outline[m:]])


def triangles(rings: list) -> np.ndarray:
    """(count, 3, 2): an outline and its holes cut into triangles."""
    outline = cleaned(rings[0], True) if rings else np.empty((0, 2))
    if not len(outline):
        return np.empty((0, 3, 2))
    holes = [h for h in (cleaned(r, False) for r in rings[1:]) if len(h)]
    for hole in sorted(holes, key=lambda h: -h[:, 0].max()):
        outline = _bridged(outline, hole)
    left, out = list(range(len(outline))), []
    while len(left) > 3:
        for j in range(len(left)):
            ends = left[j - 1], left[j], left[(j + 1) % len(left)]
            p, q, r = outline[list(ends)]
            turn = _turn(p, q, r)
            if turn < 0:
                continue
            others = outline[[i for i in left if i not in ends]]
            # points of a bridge lie twice; a corner's twin is not in the way
            others = others[(others != p).any(axis=1) & (others != q).any(axis=1) & (others != r).any(axis=1)]
            sides = [(t[0] - s[0]) * (others[:, 1] - s[1]) - (t[1] - s[1]) * (others[:, 0] - s[0]) >= 0 for s, t in ((p, q), (q, r), (r, p))]
            if turn == 0 or not (sides[0] & sides[1] & sides[2]).any():
                if turn > 0:
                    out.append((p, q, r))
                del left[j]
                break
        else:
            raise ValueError("a polygon crosses itself")
    last = outline[left]
    return np.array([*out, last] if _turn(*last) > 0 else out).reshape(-1, 3, 2)


def _cut(parts, names: tuple[str, str]) -> np.ndarray:
    value = lambda p: [np.nan if p is None or p[n] is None else p[n] for n in names]
    found = [triangles([[value(p) for p in ring] for ring in part if ring is not None]) for part in (parts if parts is not None else ()) if part is not None]
    return np.concatenate([np.empty((0, 3, 2)), *found])


def triangulated(polygons: DataFrame, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """id, n, flat: the corners of each polygon's triangles one after the other."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array([_cut(p.as_py(), names).ravel() for p in batch.column("parts")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), flat], ["id", "n", "flat"])

    # small in bytes but long in work, so dealt to a fixed number of tasks
    used = polygons.select("id", F.col("n").cast("long").alias("n"), "parts").repartition(_tasks(polygons))
    return used.mapInArrow(cut, _fields(polygons, "n bigint, flat array<double>"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fields(polygons: DataFrame, others: str) -> T.StructType:
    return T.StructType([T.StructField("id", polygons.schema["id"].dataType), *T.StructType.fromDDL(others)])


def _seed(seed: int, name: str, block: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, zlib.crc32(name.encode()), len(name), block])))


def drawn(flat: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """(count, 2): points of triangles by their areas."""
    tri = np.asarray(flat, float).reshape(-1, 3, 2)
    a, u, v = tri[:, 0], tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    share = np.cumsum(np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]))
    which = np.minimum(np.searchsorted(share, rng.random(count) * share[-1], side="right"), len(tri) - 1)
    s, t = rng.random((2, count, 1))
    # the half of the parallelogram beyond the triangle is folded back
    s, t = np.where(s + t > 1, 1 - s, s), np.where(s + t > 1, 1 - t, t)
    return a[which] + s * u[which] + t * v[which]


def in_plane(polygons: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """id, k (from 0 up to n), x, y: points of polygons in the plane."""
    cut = triangulated(polygons)
    kept = cut.where((F.col("n") > 0) & (F.size("flat") > 0))
    blocks = kept.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block).cast("long"))).alias("b"), "n", "flat")
    # a polygon with many draws is dealt over all tasks
    dealt = blocks.repartition(_tasks(polygons), F.xxhash64("id", "b")).select("*", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, b, n, flat = (batch.column(c) for c in ("name", "b", "n", "flat"))
            first = b.to_numpy() * block
            count = np.minimum(block, n.to_numpy() - first)
            # as many rows at once as make up a bounded number of points
            group = np.cumsum(count) // AT_ONCE
            for rows in np.split(np.arange(len(count)), np.flatnonzero(np.diff(group)) + 1):
                xy = np.concatenate([drawn(flat[i].values.to_numpy(zero_copy_only=False), count[i], _seed(seed, name[i].as_py(), b[i].as_py())) for i in rows])
                k = np.concatenate([first[i] + np.arange(count[i]) for i in rows])
                own = batch.column("id").take(pa.array(np.repeat(rows, count[rows])))
                yield pa.RecordBatch.from_arrays([own, pa.array(k), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["id", "k", "x", "y"])

    return dealt.mapInArrow(points, _fields(polygons, "k bigint, x double, y double"))


def on_sphere(polygons: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """id, k, lon, lat: the same for polygons of longitudes and latitudes, evenly by area on the sphere."""
    point = lambda p: F.struct(*(c.alias(n) for c, n in zip(geo.sinusoidal(p["lon"], p["lat"]), "xy")))
    flat = polygons.withColumn("parts", F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, point))))
    lon, lat = geo.from_sinusoidal(F.col("x"), F.col("y"))
    return in_plane(flat, seed, block).select("id", "k", lon.alias("lon"), lat.alias("lat"))
