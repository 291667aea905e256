"""Values at sites between scattered nodes: linear over the triangles of Delaunay's triangulation.

The triangle around a site is found without triangulating anything else.  Of all
weights that write the site as a mean of nodes, those of least mean squared
distance are its weights in that triangle: a linear program in three unknowns,
solved by exchanging one corner at a time, for all sites of a batch at once.

Nodes and sites meet on cells, in an equi-join: a cell holds the nodes of itself
and the eight around it.  A triangle found there is the right one if the circle
through its corners lies in those nine cells, as no node beyond can then be inside
it.  The other sites go to cells four times as wide, and so on, until the cells
hold all nodes.  Sites beyond one of the lines that bound the nodes in 16
directions lie outside for sure and are not searched.  First cells have four nodes
on average, so a cell's array is bounded by how densely nodes lie, not by their
number; a site in an empty area takes cells as wide as that area.

Defined results: no value outside the nodes' convex hull, for sites without
coordinates, and where a corner of the triangle has none; nodes at one place count
as their mean; nodes without coordinates do not exist; of four corners of a
rectangle the pairs are chosen alike everywhere, as if the plane were sheared by
1e-7; repeated sites are rows of their own; no nodes: no values, and nodes
all on one line give values on that line alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..staging import staged

PER_CELL, WIDER, DIRECTIONS, SHEAR = 4.0, 4.0, 16, 1e-7
#: Squared distance of the three helping corners, in squares of a cell's reach; sites worked on together.
FAR, TOGETHER, MOST_STEPS = 1e6, 512, 1000


def triangles(px: np.ndarray, py: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each site the numbers of three nodes, their weights, and the circle through them (x, y, radius).

    A number from ``len(xs)`` on stands for a helping corner; with a weight above
    zero the site lies outside the nodes' hull.
    """
    n = len(xs)
    mx, my = (xs.min() + xs.max()) / 2, (ys.min() + ys.max()) / 2
    size = max(np.abs(xs - mx).max(), np.abs(ys - my).max(), np.abs(px - mx).max(), np.abs(py - my).max(), 1e-12)
    x = np.concatenate([(xs - mx) / size, [8.0, -8.0, -8.0]])
    y = np.concatenate([(ys - my) / size, [0.0, 16.0, -16.0]])
    corners = np.tile(np.arange(n, n + 3), (len(px), 1))
    weights, circle = np.zeros((len(px), 3)), np.zeros((len(px), 3))
    left = np.arange(len(px))
    for _ in range(MOST_STEPS):
        if not len(left):
            break
        dx, dy = x[None] - ((px[left] - mx) / size)[:, None], y[None] - ((py[left] - my) / size)[:, None]
        q = dx * dx + dy * dy + SHEAR * dx * dy
        q[:, n:] = FAR
        own, row = corners[left], np.arange(len(left))[:, None]
        (x0, x1, x2), (y0, y1, y2), (q0, q1, q2) = (v[row, own].T for v in (dx, dy, q))
        area = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
        w = np.stack([x1 * y2 - x2 * y1, x2 * y0 - x0 * y2, x0 * y1 - x1 * y0], 1) / area[:, None]
        # the plane through the lifted corners, and how far each lifted node lies above it
        a = ((q1 - q0) * (y2 - y0) - (q2 - q0) * (y1 - y0)) / area
        b = ((x1 - x0) * (q2 - q0) - (x2 - x0) * (q1 - q0)) / area
        c = (w * np.stack([q0, q1, q2], 1)).sum(1)
        above = q - (c[:, None] + a[:, None] * dx + b[:, None] * dy)
        above[row, own] = 0
        enters = above.argmin(1)
        done = above[row[:, 0], enters] >= -1e-13 * (1 + np.abs(a) + np.abs(b) + np.abs(c))
        weights[left], circle[left] = w, np.stack([px[left] + a / 2 * size, py[left] + b / 2 * size, np.sqrt(np.maximum(c + (a * a + b * b) / 4, 0)) * size], 1)
        xe, ye = dx[row[:, 0], enters], dy[row[:, 0], enters]
        u = np.stack([(x1 - xe) * (y2 - ye) - (x2 - xe) * (y1 - ye), (x2 - xe) * (y0 - ye) - (x0 - xe) * (y2 - ye), (x0 - xe) * (y1 - ye) - (x1 - xe) * (y0 - ye)], 1) / area[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            leaves = np.where(u > 1e-12, np.maximum(w, 0) / u, np.inf).argmin(1)
        go = ~done
        corners[left[go], leaves[go]] = enters[go]
        left = left[go]
    return corners, weights, circle


def _found(px: np.ndarray, py: np.ndarray, nodes: np.ndarray, values: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (nan for none) at the sites of one cell, and which of them are certain. ``box``: west, east, south, north, infinite beyond all nodes."""
    out, sure = np.full((len(px), values.shape[1]), np.nan), np.zeros(len(px), bool)
    for k in range(0, len(px), TOGETHER):
        part = slice(k, k + TOGETHER)
        corners, weights, circle = triangles(px[part], py[part], nodes[:, 0], nodes[:, 1])
        outside = ((corners >= len(nodes)) & (weights > 1e-9)).any(1)
        x, y, r = circle.T
        inside = (x - r >= box[0]) & (x + r <= box[1]) & (y - r >= box[2]) & (y + r <= box[3])
        helped = (corners >= len(nodes)).any(1)
        sure[part] = np.isinf(box).all() | (inside & ~helped)
        used = np.where((weights > 1e-12)[:, :, None], values[np.minimum(corners, len(nodes) - 1)] * weights[:, :, None], 0.0)
        out[part] = np.where(outside[:, None], np.nan, used.sum(1))
    return out, sure


def scattered_values(nodes: DataFrame, sites: DataFrame, values: Sequence[str], by: Sequence[str] = (), x: str = "lon", y: str = "lat") -> DataFrame:
    """``sites`` (x, y, the columns ``by`` and others) with the columns ``values`` of ``nodes`` (x, y, ``by``, values).

    ``by``: what keeps maps apart, such as an event: a site takes values from the
    nodes of its own map.
    """
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    keys, key = list(by), F.struct(F.lit(0).alias("_"), *[name(c) for c in by])
    there = nodes.where(name(x).isNotNull() & name(y).isNotNull()).groupBy(key.alias("key"), name(x).cast("double").alias("x"), name(y).cast("double").alias("y")).agg(*[F.avg(name(v)).alias(f"v{k}") for k, v in enumerate(values)])
    there = staged(there.withColumn("v", F.array(*[F.coalesce(F.col(f"v{k}"), F.lit(float("nan"))) for k in range(len(values))])).select("key", "x", "y", "v"), "nodes")
    turns = [(float(np.cos(t)), float(np.sin(t))) for t in np.arange(DIRECTIONS) * 2 * np.pi / DIRECTIONS]
    edge = lambda c, s: F.col("x") * c + F.col("y") * s
    # one row a map: its bounds, its outline and the width of its first cells
    maps = there.groupBy("key").agg(F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"), F.count("*").alias("n"), F.array(*[F.max(edge(c, s)) for c, s in turns]).alias("edges"))
    span = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1e-9))
    area = F.greatest((F.col("east") - F.col("west")) * (F.col("north") - F.col("south")), span * span * 1e-6)
    maps = staged(maps.withColumn("cell", F.sqrt(area * PER_CELL / F.col("n"))), "maps")

    fields = [f for f in sites.schema if f.name not in values]
    row = F.struct(*[name(f.name) for f in fields])
    placed = sites.select(row.alias("site"), key.alias("key"), name(x).cast("double").alias("x"), name(y).cast("double").alias("y"))
    maps_of = maps.withColumnRenamed("key", "map")
    placed = placed.join(maps_of, F.col("key").eqNullSafe(F.col("map")), "left").drop("map")
    # rounding must not put a site on the outline outside
    beyond = F.exists(F.array(*[(edge(c, s) > F.col("edges")[k] + F.abs(F.col("edges")[k]) * 1e-12 + 1e-12) for k, (c, s) in enumerate(turns)]), lambda b: b)
    searched = F.coalesce(~beyond, F.lit(False)) & ~F.isnan("x") & ~F.isnan("y")
    placed = staged(placed.withColumn("searched", searched).drop("edges"), "sites")
    nothing = F.lit(None).cast("array<double>")
    done = [placed.where(~F.col("searched")).select("site", nothing.alias("v"))]
    left, width, box = placed.where("searched").drop("searched"), 1.0, ("west", "east", "south", "north")
    while True:
        size = F.col("cell") * width
        at = lambda c, low: F.floor((F.col(c) - F.col(low)) / size)  # noqa: B023, E731
        spread = there.join(maps_of, F.col("key").eqNullSafe(F.col("map"))).select("key", at("x", "west").alias("cx"), at("y", "south").alias("cy"), "x", "y", "v")
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        spread = spread.select("key", "cx", "cy", "x", "y", "v", around.alias("d")).select("key", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), F.struct("x", "y", "v").alias("node"))
        cells = spread.groupBy(F.to_json("key").alias("map"), "cx", "cy").agg(F.collect_list("node").alias("nodes"))
        own = left.withColumn("cx", at("x", "west")).withColumn("cy", at("y", "south")).withColumn("map", F.to_json("key"))
        low = lambda c, edge: F.when(F.col(edge) + (F.col(c) - 1) * size <= F.col(edge), -float("inf")).otherwise(F.col(edge) + (F.col(c) - 1) * size)  # noqa: B023, E731
        high = lambda c, edge, end: F.when(F.col(edge) + (F.col(c) + 2) * size >= F.col(end), float("inf")).otherwise(F.col(edge) + (F.col(c) + 2) * size)  # noqa: B023, E731
        bounds = F.array(low("cx", "west"), high("cx", "west", "east"), low("cy", "south"), high("cy", "south", "north"))
        met = own.withColumn("box", bounds).join(cells, ["map", "cx", "cy"], "left")
        flat = met.select(*left.columns, "map", "cx", "cy", "box", F.col("nodes.x").alias("nx"), F.col("nodes.y").alias("ny"), F.flatten("nodes.v").alias("nv"))
        found = staged(flat.mapInArrow(_search(left.columns, len(values)), StructType([*left.schema, StructField("v", flat.schema["box"].dataType), StructField("sure", BooleanType())])), "found")
        done.append(found.where("sure").select("site", "v"))
        left, width = found.where("not sure").select(*left.columns), width * WIDER
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    value = lambda k: F.when(~F.isnan(F.col("v")[k]), F.col("v")[k]).cast(DoubleType())
    return out.select("site.*", *[value(k).alias(v) for k, v in enumerate(values)])


def _search(columns: list[str], width: int):
    """Sites with the arrays of their cell: the same sites with values, and whether they are certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            px, py = (get(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            out, sure = np.full((batch.num_rows, width), np.nan), np.zeros(batch.num_rows, bool)
            cells: dict[tuple, list[int]] = {}
            for k, cell in enumerate(zip(*(get(c).to_pylist() for c in ("map", "cx", "cy")))):
                cells.setdefault(cell, []).append(k)
            for own in cells.values():
                nx, box = get("nx")[own[0]], np.array(get("box")[own[0]].as_py())
                if not nx.is_valid:  # no node near
                    sure[own] = np.isinf(box).all()
                    continue
                nodes = np.stack([nx.values.to_numpy(), get("ny")[own[0]].values.to_numpy()], 1)
                out[own], sure[own] = _found(px[own], py[own], nodes, get("nv")[own[0]].values.to_numpy().reshape(-1, width), box)
            kept = [get(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(out), pa.list_(pa.float64())), pa.array(sure)], names=[*columns, "v", "sure"])

    return run
