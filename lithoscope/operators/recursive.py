"""Recursive filters and oscillators over long records, in segments that run in many tasks.

A filter is a linear machine: state and sample give output and next state.  Long
rows (sid, i, v) are gathered into segments of at most ``SEGMENT`` samples.  Each
segment is run from rest for its last state; what it does to any state before it
is a power of the machine's matrix.  States at the segments' borders follow by
running through these maps, ``FAN`` at a time: the maps of neighbours compose to
one, level by level, so that no task holds more than ``FAN`` of them, however long
a record is.  Then each segment is run once more, from its true state.  Segments
of a batch are run side by side, one sample of each at a time.

Defined results: samples go by ``i``, gaps in it count for nothing; null values
are 0; rows of one i follow each other by value; a null sid is a source; an empty
frame gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

SEGMENT, FAN = 1024, 1024


@dataclass
class Machine:
    """y = c s + d v and s' = a s + b v; before the first sample v the state is ``first`` v."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    first: np.ndarray

    def then(self, other: Machine) -> Machine:
        """Both in a row; this one has one output."""
        a = np.block([[self.a, np.zeros((len(self.a), len(other.a)))], [np.outer(other.b, self.c[0]), other.a]])
        b = np.concatenate([self.b, other.b * self.d[0]])
        return Machine(a, b, np.hstack([np.outer(other.d, self.c[0]), other.c]), other.d * self.d[0], np.concatenate([self.first, other.first]))

    def run(self, values: np.ndarray, sizes: np.ndarray, states: np.ndarray, outputs: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Outputs (segments by samples by outputs) and last states of segments with ``sizes`` samples each."""
        out = np.empty((*values.shape, len(self.c))) if outputs else None
        states = states.copy()
        for k in range(values.shape[1]):
            v = values[:, k]
            if outputs:
                out[:, k] = states @ self.c.T + v[:, None] * self.d
            after = states @ self.a.T + v[:, None] * self.b
            states = np.where((k < sizes)[:, None], after, states)
        return out, states


# filters


def _design(order: int, corners: list[float], delta: float, kind: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth filter, by the bilinear transform of the analogue one."""
    fs2 = 2 / delta
    warped = [fs2 * math.tan(math.pi * f * delta) for f in corners]
    poles = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "low":
        zeros, poles, gain = np.zeros(0), poles * warped[0], warped[0] ** order
    elif kind == "high":
        zeros, poles, gain = np.zeros(order), warped[0] / poles, 1.0
    else:
        half, centre = poles * (warped[1] - warped[0]) / 2, warped[0] * warped[1]
        root = np.sqrt(half**2 - centre)
        zeros, poles, gain = np.zeros(order), np.concatenate([half + root, half - root]), (warped[1] - warped[0]) ** order
    gain *= (np.prod(fs2 - zeros) / np.prod(fs2 - poles)).real
    digital = (fs2 + zeros) / (fs2 - zeros)
    return np.concatenate([digital, -np.ones(len(poles) - len(zeros))]), (fs2 + poles) / (fs2 - poles), float(gain)


def butterworth(delta: float, highpass: float | None = None, lowpass: float | None = None, order: int = 4) -> Machine:
    """A causal Butterworth filter as second-order sections, one after the other, at rest before the record."""
    corners = [f for f in (highpass, lowpass) if f is not None]
    if not corners or not all(0 < f < 0.5 / delta for f in corners) or sorted(set(corners)) != corners:
        raise ValueError("corner frequencies must rise and lie between zero and half the rate")
    if order < 1:
        raise ValueError("the order must be positive")
    zeros, poles, gain = _design(order, corners, delta, "band" if len(corners) == 2 else "high" if lowpass is None else "low")
    real = sorted(p.real for p in poles if abs(p.imag) < 1e-12)
    pairs = [[p, p.conjugate()] for p in sorted((p for p in poles if p.imag >= 1e-12), key=abs)] + [real[k : k + 2] for k in range(0, len(real), 2)]
    # a section of a band filter has a zero on either side
    left, right = sorted(z.real for z in zeros if z.real < 0), [z.real for z in zeros if z.real >= 0]
    machine = None
    for pair in pairs:
        own = []
        for _ in pair:
            own.append((left if len(left) > len(right) else right if right else left).pop())
        numerator, denominator = np.poly(own), np.poly(pair).real
        b, a = (np.concatenate([x, np.zeros(3 - len(x))]) for x in (numerator * (gain if machine is None else 1), denominator))
        one = Machine(np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]), np.array([[1.0, 0.0]]), np.array([b[0]]), np.zeros(2))
        machine = one if machine is None else machine.then(one)
    return machine


def oscillator(delta: float, period: float, damping: float = 0.05) -> Machine:
    """Relative displacement and velocity and total acceleration of an oscillator under an acceleration, by constant average acceleration."""
    w = 2 * math.pi / period
    c, k = 2 * damping * w, w * w
    stiff = k + 2 * c / delta + 4 / delta**2

    def step(d: float, v: float, before: float, now: float) -> tuple[float, float]:
        a = -before - c * v - k * d
        moved = (-now + d * (4 / delta**2 + 2 * c / delta) + v * (4 / delta + c) + a) / stiff
        return moved, 2 * (moved - d) / delta - v

    columns = np.array([step(*row) for row in np.eye(4)]).T  # of d, v, the sample before and the sample now
    a, b = np.vstack([columns[:, :3], np.zeros(3)]), np.concatenate([columns[:, 3], [1.0]])
    outputs = np.array([[1, 0], [0, 1], [-k, -c]])
    # at the first sample it is at rest: such a state before it leads there
    first = np.linalg.lstsq(a[:2], -b[:2], rcond=None)[0]
    return Machine(a, b, outputs @ a[:2], outputs @ b[:2], first)


# frames


def segments(samples: DataFrame, size: int = SEGMENT) -> DataFrame:
    """sid, seg (from 0), data: at most ``size`` samples in a row; numbers are taken as they are, so they should follow each other."""
    value = F.coalesce(F.col("v").cast("double"), F.lit(0.0))
    rows = samples.select("sid", F.floor(F.col("i") / size).alias("seg"), F.struct("i", value.alias("v")).alias("x"))
    return rows.groupBy("sid", "seg").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("data"))


def _padded(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in arrays])
    out = np.zeros((len(arrays), sizes.max(initial=0)))
    for row, x in zip(out, arrays):
        row[: len(x)] = x
    return out, sizes


def _mapped(rows: DataFrame, schema: str, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, pa.Array]]) -> DataFrame:
    """What ``work`` makes of batches of segments, beside sid and seg."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):  # so many segments side by side
                batch = whole.slice(k, 256)
                data = [np.asarray(x.values, float) for x in batch.column(batch.schema.get_field_index("data"))]
                made = work(batch, *_padded(data))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(made[n] for n in names)], names=["sid", "seg", *names])

    kind = rows.schema["sid"].dataType.simpleString()
    return rows.mapInArrow(run, f"sid {kind}, seg long, {schema}")


def _scan(maps: DataFrame, machine: Machine) -> DataFrame:
    """sid, seg, state: the state before each segment, of maps (sid, seg, n, state): n samples lead from rest to state."""
    kind = maps.schema["sid"].dataType.simpleString()
    powers: dict[int, np.ndarray] = {}

    def through(n: int, state: np.ndarray, add: np.ndarray) -> np.ndarray:
        if n not in powers:
            powers[n] = np.linalg.matrix_power(machine.a, n)
        return powers[n] @ state + add

    def entries(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("seg")
        state, out = np.zeros(len(machine.a)) if own["entry"].iloc[0] is None else np.array(own["entry"].iloc[0], float), []
        for n, add in zip(own["n"], own["state"]):
            out.append(state)
            state = through(int(n), state, np.array(add, float))
        return pd.DataFrame({"sid": own["sid"], "seg": own["seg"], "state": out})

    def composed(own: pd.DataFrame) -> pd.DataFrame:
        own, state = own.sort_values("seg"), np.zeros(len(machine.a))
        for n, add in zip(own["n"], own["state"]):
            state = through(int(n), state, np.array(add, float))
        return pd.DataFrame({"sid": own["sid"].iloc[:1], "seg": own["up"].iloc[:1], "n": [int(own["n"].sum())], "state": [state]})

    rows, last = maps.withColumn("up", F.floor(F.col("seg") / FAN)), maps.agg(F.max("seg")).first()[0] or 0
    if not last:  # nothing comes before a first segment
        return maps.select("sid", "seg", F.array_repeat(F.lit(0.0), len(machine.a)).alias("state"))
    if last < FAN:
        rows = rows.withColumn("entry", F.lit(None).cast("array<double>"))
    else:
        above = staged(rows.groupBy("sid", "up").applyInPandas(composed, f"sid {kind}, seg long, n long, state array<double>"), "maps")
        before = _scan(above, machine).select(F.col("sid").alias("_sid"), F.col("seg").alias("_up"), F.col("state").alias("entry"))
        rows = rows.join(before, F.col("sid").eqNullSafe(F.col("_sid")) & (F.col("up") == F.col("_up"))).drop("_sid", "_up")
    return rows.groupBy("sid", "up").applyInPandas(entries, f"sid {kind}, seg long, state array<double>")


def _entered(pieces: DataFrame, machine: Machine) -> DataFrame:
    """Segments with the state before each."""
    rest = len(machine.a)

    def alone(batch: pa.RecordBatch, values: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
        # what comes before the first sample counts with the first segment
        at_first = np.array(batch.column(batch.schema.get_field_index("first")).to_pylist(), bool)
        states = np.where(at_first[:, None], values[:, :1] * machine.first, np.zeros((len(values), rest)))
        return {"n": pa.array(sizes, pa.int64()), "state": pa.array(list(machine.run(values, sizes, states, outputs=False)[1]), pa.list_(pa.float64()))}

    maps = staged(_mapped(pieces, "n long, state array<double>", alone), "maps")
    entries = _scan(maps, machine).select(F.col("sid").alias("_sid"), F.col("seg").alias("_seg"), "state")
    return pieces.join(entries, F.col("sid").eqNullSafe(F.col("_sid")) & (F.col("seg") == F.col("_seg"))).drop("_sid", "_seg")


def _pieces(samples: DataFrame, size: int) -> DataFrame:
    """Segments numbered without gaps, the first one of a source marked."""
    rows = staged(segments(samples, size), "segments")
    order = Window.partitionBy("sid").orderBy("seg")
    return rows.withColumn("seg", (F.row_number().over(order) - 1).cast("long")).withColumn("first", F.col("seg") == 0)


def _states(batch: pa.RecordBatch, machine: Machine, values: np.ndarray) -> np.ndarray:
    given = np.array(batch.column(batch.schema.get_field_index("state")).to_pylist(), float)
    first = np.array(batch.column(batch.schema.get_field_index("first")).to_pylist(), bool)
    return np.where(first[:, None], values[:, :1] * machine.first, given)


def filtered(samples: DataFrame, machine: Machine, size: int = SEGMENT) -> DataFrame:
    """sid, k (place in its source, from 0), y: the first output of the machine for each sample (sid, i, v)."""

    def work(batch: pa.RecordBatch, values: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
        out = machine.run(values, sizes, _states(batch, machine, values))[0][:, :, 0]
        return {"y": pa.array([y[:n] for y, n in zip(out, sizes)], pa.list_(pa.float64()))}

    pieces = _pieces(samples, size)
    made = _mapped(_entered(pieces, machine).select("sid", "seg", "data", "first", "state"), "y array<double>", work)
    before = F.coalesce(F.sum(F.size("y")).over(Window.partitionBy("sid").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("before", before).select("sid", "before", F.posexplode("y").alias("at", "y")).select("sid", (F.col("before") + F.col("at")).alias("k"), "y")


def response_spectrum(samples: DataFrame, delta: float, periods: list[float], damping: float = 0.05, size: int = SEGMENT) -> DataFrame:
    """sid, period, sd, sv, sa, psv, psa: peaks of an oscillator's motion under each source's samples (sid, i, v).

    The oscillators of all periods are one machine, so samples are read once.
    """
    parts = [oscillator(delta, p, damping) for p in periods]
    wide = lambda blocks: np.block([[x if i == j else np.zeros((x.shape[0], y.shape[1])) for j, y in enumerate(blocks)] for i, x in enumerate(blocks)])
    whole = Machine(wide([m.a for m in parts]), np.concatenate([m.b for m in parts]), wide([m.c for m in parts]), np.concatenate([m.d for m in parts]), np.concatenate([m.first for m in parts]))

    def work(batch: pa.RecordBatch, values: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
        out = np.abs(whole.run(values, sizes, _states(batch, whole, values))[0])
        out[np.arange(values.shape[1])[None] >= sizes[:, None]] = 0
        return {"peaks": pa.array(list(out.max(1)), pa.list_(pa.float64()))}

    made = _mapped(_entered(_pieces(samples, size), whole).select("sid", "seg", "data", "first", "state"), "peaks array<double>", work)
    rows = made.select("sid", F.posexplode("peaks").alias("at", "peak")).groupBy("sid", F.floor(F.col("at") / 3).alias("p")).agg(*[F.max(F.when(F.col("at") % 3 == k, F.col("peak"))).alias(n) for k, n in enumerate(("sd", "sv", "sa"))])
    period = F.element_at(F.array(*[F.lit(float(p)) for p in periods]), F.col("p").cast("int") + 1)
    w = 2 * math.pi / F.col("period")
    return rows.select("sid", period.alias("period"), "sd", "sv", "sa").select("*", (w * F.col("sd")).alias("psv"), (w * w * F.col("sd")).alias("psa"))
