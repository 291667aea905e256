"""Candidate repeats of fixed-length windows, found through shared anchors.

A window of ``size`` elements (bytes or words) is filed under its anchor: of the
``gram``-element strings in it the one with the smallest hash, the first of
equals.  Equal windows have equal anchors at equal distances, so a window can
only recur under an anchor that recurs.  Neighbouring windows mostly share their
anchor; the windows of one anchor, a run, are covered by one stretch of elements,
its context.  Runs with the same context hold the same windows.  In a text that
repeats itself the anchor moves on to an equal one; runs of neighbours with equal
anchors are put together to ties, whose windows may recur in themselves.

Three passes over the texts, each of them a plain map:

1. hashes of anchors, counted by Spark, with partial counts in each task;
2. runs whose anchor recurs, without their elements;
3. elements of one run for each context that shares its anchor with another.

Passes 2 and 3 leave out what a bit filter of fixed size rules out; what it lets
through in error falls to the exact join behind it, so a full filter costs time
but no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, internal, others, partitions, release, slices, staged
from .words import mixed

FILTER_BITS, SLICE = 1 << 26, 1 << 18
_POSITION = 28  # low bits for the place in a slice, the others for the hash


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Runs:
    """Runs of one slice of texts: text, first window (from the start of its text), number of windows, anchor hash, context hash, whether it is a tie."""

    def __init__(self, elements: np.ndarray, bounds: np.ndarray, size: int, gram: int):
        """``elements``: bytes, or a hash for each; ``gram``: a power of two."""
        empty = np.empty(0, np.int64)
        self.text, self.first, self.windows, self.anchor, self.context, self.tie = empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
        if len(elements) < size:
            return
        if len(elements) >> _POSITION:
            raise ValueError(f"a text of 2 ** {_POSITION} elements or more")
        if elements.dtype == np.uint8:
            elements = _BYTES[elements]
        with np.errstate(over="ignore"):
            grams, step, factor = elements, 1, 0xD6E8FEB86659FD93
            while step < gram:
                grams = grams[:-step] * np.uint64(factor) + grams[step:]
                step, factor = step * 2, factor * factor % (1 << 64)
        grams = mixed(grams)
        least = grams & np.uint64((1 << 64) - (1 << _POSITION)) | np.arange(len(grams), dtype=np.uint64)
        reach, span = size - gram + 1, 1
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(elements) - size + 1], least[reach - span : reach - span + len(elements) - size + 1])
        place = (least & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        begins, ends = bounds[:-1], bounds[1:] - size  # first and last window of each text
        points = np.union1d(np.flatnonzero(np.diff(place)) + 1, begins[begins < len(place)])
        text = np.searchsorted(bounds, points, side="right") - 1
        last = np.minimum(np.concatenate([points[1:], [len(place)]]) - 1, ends[text])
        real = points <= last
        points, last, text = points[real], last[real], text[real]
        anchor, windows = grams[place[points]], last - points + 1
        short = windows <= size // 4
        same = np.zeros(len(points), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (text[1:] == text[:-1]) & short[1:] & short[:-1]
        if same.any():
            # ties of half a window at most and a little more, so that first and last window cover the whole context
            chain = np.maximum.accumulate(np.where(same, 0, np.arange(len(points))))
            ends = np.cumsum(windows)
            stretch = (ends - ends[chain]) // (size // 2)
            same[1:] &= stretch[1:] == stretch[:-1]
        heads = np.flatnonzero(~same)
        last = last[np.concatenate([heads[1:], [len(points)]]) - 1] if len(heads) else last
        self.tie = np.diff(heads, append=len(points)) > 1
        points, self.text, self.anchor = points[heads], text[heads], anchor[heads]
        self.first, self.windows = points - begins[self.text], last - points + 1
        context = self.windows.astype(np.uint64)
        with np.errstate(over="ignore"):
            for at in (points, last):
                for offset in (*range(0, size - gram, gram), size - gram):
                    context = mixed(context * np.uint64(3) + grams[at + offset])
        self.context = context


def ranges(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` elements."""
    cuts = (np.flatnonzero(np.diff(bounds[1:] // SLICE)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(bounds) - 1])) if len(bounds) > 1 else []


Elements = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def runs_of(texts: pa.Array, elements: Elements, size: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, Runs]]:
    """First text, bounds, elements and runs of each slice of a batch."""
    bounds, values = elements(texts)
    for a, b in ranges(bounds):
        own = bounds[a : b + 1] - bounds[a]
        part = values[bounds[a] : bounds[b]]
        yield a, own, part, Runs(part, own, size, gram)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def anchor_rows(docs: DataFrame, elements: Elements, size: int, gram: int) -> DataFrame:
    """anchor, doc_id, tie for every run of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(0)
            for a, _, _, runs in runs_of(batch.column(1), elements, size, gram):
                yield pa.RecordBatch.from_arrays([pa.array(signed(runs.anchor)), ids.take(pa.array(runs.text + a)), pa.array(runs.tie)], names=["anchor", "doc_id", "tie"])

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long, tie boolean")


class BitFilter:
    """Which 64-bit numbers may be in a set: two bits for each, FILTER_BITS in all."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mixed(x.view(np.uint64) if x.dtype == np.int64 else x)
        return (x % np.uint64(FILTER_BITS)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)

    def may_have(self, x: np.ndarray) -> np.ndarray:
        a, b = self.places(x)
        return ((self.bits[a >> 3] >> (a & 7).astype(np.uint8)) & (self.bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def bit_filter(df: DataFrame, numbers: Callable[[pa.RecordBatch], np.ndarray] = lambda batch: batch.column(0).to_numpy()) -> BitFilter:
    """Of the numbers of ``df``'s rows; each task sets the bits of one part of the filter, and FILTER_BITS / 8 bytes come to the driver."""
    parts, width = 64, FILTER_BITS // 64

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                both = np.concatenate(BitFilter.places(numbers(batch.slice(at, 1 << 16))))
                yield pa.RecordBatch.from_arrays([pa.array(both // width), pa.array(both)], names=["part", "place"])
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            part, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part).tolist():
                bits = made.setdefault(p, np.zeros(width, bool))
                bits[place[part == p] - p * width] = True
        for p, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])
        made.clear()
        release()

    rows = df.mapInArrow(split, "part long, place long").repartition(min(parts, partitions(df.sparkSession)), "part").mapInArrow(gather, "part long, bits binary").collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        bits[r.part * width // 8 : (r.part + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return BitFilter(bits)


def run_key(anchor: np.ndarray, context: np.ndarray, row: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(anchor + context * np.uint64(5)) + row.view(np.uint64))


def filtered_runs(docs: DataFrame, elements: Elements, size: int, gram: int, recurring: BitFilter, wanted: BitFilter | None = None, payload: Callable | None = None) -> DataFrame:
    """anchor, context, doc_id, row, first, windows, tie of the runs whose anchors recur.

    With ``wanted``, only runs whose ``run_key`` it may have, and with them
    their elements as ``payload(batch, text, first, n)`` gives them in bytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast((recurring, wanted))
    schema = "anchor long, context long, doc_id long, row long, first int, windows int, tie boolean" + ", payload binary" * (wanted is not None)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring, wanted = sent.value
        for batch in slices(batches, 1):
            ids, rows = batch.column(0), batch.column(2).to_numpy()
            for a, bounds, part, runs in runs_of(batch.column(1), elements, size, gram):
                hit = recurring.may_have(runs.anchor)
                if wanted is not None:
                    hit[hit] = wanted.may_have(run_key(runs.anchor[hit], runs.context[hit], rows[runs.text[hit] + a]))
                hit = np.flatnonzero(hit)
                text = runs.text[hit]
                made = [
                    pa.array(signed(runs.anchor[hit])),
                    pa.array(signed(runs.context[hit])),
                    ids.take(pa.array(text + a)),
                    pa.array(rows[text + a]),
                    pa.array(runs.first[hit].astype(np.int32)),
                    pa.array(runs.windows[hit].astype(np.int32)),
                    pa.array(runs.tie[hit]),
                ]
                if wanted is not None:
                    begin = bounds[text] + runs.first[hit]
                    made.append(pa.array([payload(part[b : b + n]) for b, n in zip(begin.tolist(), (runs.windows[hit] + size - 1).tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, names=names)

    return docs.select("doc_id", "text", "row").mapInArrow(run, schema)


def covered(n: int, spans: list, size: int) -> np.ndarray:
    """Which of ``n`` elements are covered by windows of ``size``; spans: (first, windows, mask of windows or None for all)."""
    change = np.zeros(n + 1, np.int64)
    whole = np.array([(first, first + windows + size - 1) for first, windows, mask in spans if mask is None], np.int64).reshape(-1, 2)
    np.add.at(change, whole[:, 0], 1)
    np.add.at(change, np.minimum(whole[:, 1], n), -1)
    for first, windows, mask in spans:
        if mask is not None:
            hit = first + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=windows))
            change[hit] += 1
            np.add.at(change, np.minimum(hit + size, n), -1)
    return np.cumsum(change[:-1]) > 0


#: Anchors with more contexts than this are searched window by window.
MOST_CONTEXTS = 2048

Search = Callable[[Iterator[list[dict]]], Iterator[tuple[int, int, bytes]]]


def recurring_windows(docs: DataFrame, elements: Elements, payload: Callable, size: int, gram: int, by_document: bool, search: Search) -> DataFrame:
    """doc_id, row, spans (first, windows, mask or null for all of them): the windows of each text that occur elsewhere.

    ``docs``: doc_id, text, row (the same for equal rows; rows of other doc_ids may share it).  ``by_document``:
    elsewhere is a document with a smaller doc_id; otherwise any other place.
    ``search`` gets the contexts of one anchor after the other (ordered by
    doc_id; with anchor, context, doc_id, n occurrences, windows, payload) and
    gives masks of the windows that occur elsewhere among them.

    Contexts are grouped before anything is searched, so copies of a passage are
    one row.  An anchor with very many contexts is dealt out by the hashes of its
    windows, each a group of its own that Spark aggregates.
    """
    rows = anchor_rows(docs, elements, size, gram)
    if by_document:
        recurring = rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    else:
        recurring = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.max("tie").alias("tie")).where("n > 1 or tie")
    recurring = staged(recurring.select("anchor"), "anchors")
    known = bit_filter(recurring)
    runs = staged(filtered_runs(docs, elements, size, gram, known), "runs")

    contexts = staged(runs.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row")).alias("first"), F.first("windows").alias("windows"), F.max("tie").alias("tie")), "contexts")
    # what occurs once and only once needs no search, nor do anchors all of whose contexts recur as a whole
    shared = contexts.groupBy("anchor").agg(F.count("*").alias("n_contexts"), F.min("n").alias("least"), F.max("tie").alias("tie"))
    shared = shared.where("n_contexts > 1" if by_document else "least = 1 and (n_contexts > 1 or tie)")
    open_contexts = staged(contexts.join(shared.select("anchor", "n_contexts"), "anchor").select("anchor", "context", "n", "n_contexts", F.col("first.row").alias("row")), "open")
    wanted = bit_filter(open_contexts.select("anchor", "context", "row"), lambda batch: run_key(*(c.to_numpy().view(np.uint64) for c in batch.columns)))
    found = filtered_runs(docs, elements, size, gram, known, wanted, payload)
    # a context may stand more than once in its row
    found = staged(found.join(open_contexts, ["anchor", "context", "row"]).dropDuplicates(["anchor", "context"]), "searched")

    few = found.where(F.col("n_contexts") <= MOST_CONTEXTS)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for result in search(rows.to_pylist() for rows in groups(batches, ["anchor"])):
            made.append(result)
            if len(made) >= 4096:
                yield _masks(made)
                made = []
        if made:
            yield _masks(made)
        release()

    dealt = few.select("anchor", "context", "doc_id", "n", "windows", "payload").repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "doc_id", "context")
    masks = dealt.mapInArrow(searched, MASKS).unionByName(_window_masks(found.where(F.col("n_contexts") > MOST_CONTEXTS), size, by_document))

    # what is known of each context is put together first: the join with its runs is then one that Spark can split where a context is hot
    whole = F.col("doc_id") > F.col("low") if by_document else F.col("n") > 1
    known_of = contexts.select("anchor", "context", "n", F.col("first.doc_id").alias("low")).join(masks, ["anchor", "context"], "left")
    known_of = staged(known_of.where("mask is not null or n > 1"), "known")
    return (
        runs.join(known_of, ["anchor", "context"])
        .withColumn("whole", whole)
        .where("whole or mask is not null")
        .groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct("first", "windows", F.when(~F.col("whole"), F.col("mask")).alias("mask"))).alias("spans"))
    )


MASKS = "anchor long, context long, mask binary"


def _masks(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary())], names=["anchor", "context", "mask"])


def _window_masks(found: DataFrame, size: int, by_document: bool) -> DataFrame:
    """Masks for contexts of very frequent anchors: their windows are grouped by content (its hash beside the anchor's)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                unit = len(r["payload"]) // (r["windows"] + size - 1)
                rows += [(r["anchor"], r["context"], r["doc_id"], r["n"], k, np.uint64(xxhash.xxh3_64_intdigest(r["payload"][k * unit : (k + size) * unit])).astype(np.int64)) for k in range(r["windows"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=["anchor", "context", "doc_id", "n", "k", "window"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                bits = np.zeros(max(r["hits"]) + 1, bool)
                bits[r["hits"]] = True
                made.append((r["anchor"], r["context"], np.packbits(np.concatenate([bits, np.zeros(size, bool)])).tobytes()))
            yield _masks(made)

    windows = found.select("anchor", "context", "doc_id", "n", "windows", "payload").mapInArrow(cut, "anchor long, context long, doc_id long, n long, k long, window long")
    kinds = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.sum("n").alias("total"))
    hit = F.col("doc_id") > F.col("low") if by_document else F.col("total") > 1
    hits = windows.join(kinds, ["anchor", "window"]).where(hit).groupBy("anchor", "context").agg(F.collect_list("k").alias("hits"))
    return hits.mapInArrow(join_up, MASKS)


def with_spans(docs: DataFrame, searched: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` and, as the last column, the spans that ``find`` has for them; ``searched``: those of ``docs`` to look at.

    A row is known by its doc_id and a hash of its text.
    """
    row, own, other, spans = (internal(docs.columns, c) for c in ("_row", "_own", "_other", "_spans"))
    hashed = F.xxhash64("doc_id", "text")
    found = find(searched.select(F.col("doc_id").cast("long").alias("doc_id"), "text", hashed.alias("row"))).select(F.col("doc_id").alias(own), F.col("row").alias(other), F.col("spans").alias(spans))
    keyed = docs.withColumn(row, hashed)
    return keyed.join(found, (F.col(row) == F.col(other)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").select(*others(docs), spans)
