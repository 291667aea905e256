"""Sequence packing as a cutting-stock problem solved by column generation.

Documents longer than a sequence are cut into full sequences and a rest.  Pieces
are counted by length class (lengths rounded up to ``capacity / UNITS``), which
gives a histogram of at most ``UNITS`` bars however many documents there are.  A
linear program chooses how often to use each pattern of classes that fits into a
sequence; patterns come from an unbounded knapsack (dynamic programming over the
units) that prices the classes by the program's dual values, smoothed, until no
pattern is worth more than it costs, what can still be gained is below ``GAP``,
or ``MOST_COLUMNS`` patterns were tried (then padding may be a little more; every
piece is placed all the same).  Pattern counts are rounded down, and the few
pieces then left over are placed first-fit in order of size.

Pieces are ranked within their class, in buckets so that no class is sorted in
one task, and the rank leads to a pattern, its copy and so to a sequence.  The
table of ranges it is looked up in has a row for each pattern and class
(bounded by ``UNITS``, not by the corpus) and is broadcast.

Defined results: a null text counts as empty and an empty text is the end id
alone; repeated rows are documents of their own; a null doc_id is packed like
any other; ties within a class go by doc_id, then start; an empty table gives no
rows; further columns are ignored by ``cut_documents`` and kept by ``pack``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, internal, others, partitions, slices, staged
from .encoding import ENCODER, encoder

CAPACITY, UNITS, GAP, MOST_COLUMNS = 2048, 128, 5e-4, 6000
TRUST = (0.9, 0.5, 0.0)

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and with ``with_ids`` its ids (little-endian, 4 bytes each)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches, 1, keep=ENCODER):
            ids, bounds = enc.encode(batch.column(1))
            ids = ids.astype("<u4")
            sizes = np.diff(bounds)
            many = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), many)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * capacity
            length = np.minimum(capacity, sizes[owner] - start)
            raw, begin = memoryview(ids).cast("B"), (bounds[owner] + start) * 4
            parts = [raw[b : b + n] for b, n in zip(begin.tolist(), (length * 4).tolist())]
            made = [batch.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(sizes[owner])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                made, names = [*made, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(made, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def best_pattern(prices: np.ndarray, classes: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of a sequence, any number of each class: its value and how many of each."""
    value, choice = np.zeros(units + 1), np.full(units + 1, -1)
    for c in range(1, units + 1):
        fits = np.searchsorted(classes, c, side="right")
        value[c] = value[c - 1]
        if fits:
            gain = value[c - classes[:fits]] + prices[:fits]
            k = int(gain.argmax())
            if gain[k] > value[c] + 1e-12:
                value[c], choice[c] = gain[k], k
    filling, c = np.zeros(len(classes)), units
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            filling[choice[c]] += 1
            c -= classes[choice[c]]
    return float(value[units]), filling


def _refined(inverse: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Take out the small errors that updates of the inverse have added up (Newton's iteration)."""
    for _ in range(2):
        inverse = inverse @ (2 * np.eye(len(columns)) - columns @ inverse)
    return inverse


def solve(demand: dict[int, int], units: int = UNITS) -> list[tuple[int, dict[int, int]]]:
    """How often to use which pattern (class: pieces of it) so that every piece is placed once."""
    classes = np.array(sorted(demand))
    if not len(classes):
        return []
    need = np.array([demand[int(c)] for c in classes], float)
    columns = np.diag(units // classes).astype(float)  # the basis: one pattern a column
    inverse, used = np.diag(1 / np.diag(columns)), need / np.diag(columns)
    # Prices kept near the best feasible ones so far stop the duals from swinging; a class's share of a sequence is feasible.
    centre = classes / units
    bound = need @ centre
    for turn in range(MOST_COLUMNS):
        if turn % 25 == 24:
            inverse = _refined(inverse, columns)
            used = np.maximum(inverse @ need, 0)
        duals, filling = inverse.sum(axis=0), None  # every pattern costs one sequence
        for trust in TRUST:
            prices = np.maximum(trust * centre + (1 - trust) * duals, 0)
            worth, found = best_pattern(prices, classes, units)
            if need @ prices / max(worth, 1) > bound:
                centre, bound = prices / max(worth, 1), need @ prices / max(worth, 1)
            if duals @ found > 1 + 1e-9:
                filling = found
                break
        if filling is None or used.sum() - bound <= GAP * bound:
            break
        into = inverse @ filling
        able = into > 1e-9
        ratio = np.where(able, used / np.where(able, into, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * into, 0)
        used[out] = step
        inverse[out] /= into[out]
        others = np.arange(len(classes)) != out
        inverse[others] -= into[others, None] * inverse[out]
        columns[:, out] = filling
    used = np.maximum(_refined(inverse, columns) @ need, 0)
    times = np.floor(used + 1e-6).astype(np.int64)
    left = need.astype(np.int64) - (columns @ times).astype(np.int64)
    while (left < 0).any():  # rounding up by 1e-6 took too many of a class
        times[int(np.flatnonzero((columns[left < 0] > 0).any(axis=0) & (times > 0))[0])] -= 1
        left = need.astype(np.int64) - (columns @ times).astype(np.int64)
    out = [(int(n), {int(c): int(k) for c, k in zip(classes, columns[:, j]) if k}) for j, n in enumerate(times) if n]
    while left.any():
        filling, room = {}, units
        for j in range(len(classes) - 1, -1, -1):
            k = min(int(left[j]), room // int(classes[j]))
            if k:
                filling[int(classes[j])] = k
                left[j] -= k
                room -= k * int(classes[j])
        out.append((1, filling))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, units: int = UNITS) -> DataFrame:
    """``pieces`` (doc_id, start, length up to ``capacity``, and whatever else) with sequence_id and offset.

    Columns of these two names are replaced, all others kept.  ``pieces`` is read
    several times; stage it first if it is costly to make.
    """
    spark = pieces.sparkSession
    buckets = partitions(spark)
    pieces = pieces.select(others(pieces, "sequence_id", "offset"))
    kind, bucket, number, lowest, highest, each, sequence, before_it, place, rank = (
        internal(pieces.columns, f"_{c}") for c in ("class", "bucket", "number", "from", "to", "each", "sequence", "before", "place", "rank")
    )
    rows = pieces.withColumn(kind, F.ceil(F.col("length") * units / capacity).cast("int")).withColumn(bucket, F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counted = staged(rows.groupBy(kind, bucket).agg(F.count("*").alias(number)), "lengths")
    demand = {r[0]: r[1] for r in counted.groupBy(kind).agg(F.sum(number)).collect()}  # at most ``units`` rows
    ranges, used, taken = [], 0, dict.fromkeys(demand, 0)
    for times, filling in solve(demand, units):
        for c, k in filling.items():
            ranges.append((c, taken[c], taken[c] + times * k, k, used))
            taken[c] += times * k
        used += times
    lookup = spark.createDataFrame(ranges, f"{kind} int, {lowest} long, {highest} long, {each} int, {sequence} long")
    before = Window.partitionBy(kind).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # rows alike in all of these are alike in what they show, so a stage that is run again places them alike
    order = [c for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens") if c in pieces.columns]
    first = counted.withColumn(before_it, F.coalesce(F.sum(number).over(before), F.lit(0))).drop(number)
    ranked = (
        rows.withColumn(place, F.row_number().over(Window.partitionBy(kind, bucket).orderBy(*order)))
        .join(first, [kind, bucket])
        .withColumn(rank, F.col(before_it) + F.col(place) - 1)
    )
    # a row for each pattern and class: bounded by ``units`` and MOST_COLUMNS, whatever the corpus
    placed = ranked.join(F.broadcast(lookup), [kind]).where((F.col(rank) >= F.col(lowest)) & (F.col(rank) < F.col(highest)))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", rank).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("sequence_id", F.col(sequence) + F.floor((F.col(rank) - F.col(lowest)) / F.col(each)))
        .withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
        .select(*others(pieces), "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` with its sequence and offset; pieces are staged, without their ids."""
    return pack(staged(cut_documents(docs, tokenizer, capacity), "pieces"), capacity)


def write_sequences(docs: DataFrame, path: str, tokenizer: str, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """Pack ``docs`` and write the padded sequences: sequence_id, ids (little-endian, 4 bytes each), lengths of the pieces.

    A sequence is padded with ``pad`` to ``capacity``, unless its length is a power of two.
    """
    placed = pack(staged(cut_documents(docs, tokenizer, capacity, with_ids=True), "pieces"), capacity)
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    size = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    padding = F.when(F.bit_count(size) == 1, 0).otherwise(capacity - size).cast("int")
    unit = F.unhex(F.lit(pad.to_bytes(4, "little").hex()))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    filler = F.aggregate(F.array_repeat(unit, padding), F.lit(b""), lambda a, x: F.concat(a, x))
    whole.select("sequence_id", F.concat(joined, filler).alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)
