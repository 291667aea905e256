"""Text quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of word shapes: each word becomes the sequence of its kinds of
characters (small and capital letters, digits, characters beyond Latin letters,
each mark for itself) with runs cut to one, and shapes, pairs of neighbouring
shapes and words that repeat the one before are counted (hashed into a fixed
number of columns).  Counts are damped, weighted by inverse document frequency over the
labelled rows, and projected on the leading singular directions.  Every document
is compared by exact cosine with every labelled vector, in blocks; the ``k``
nearest vote with their labels, weighted by a power of the cosine.

Bounds: the labelled vectors come from at most ``per_label`` rows of each label,
those with the smallest hashes of their ids (of several texts with one id, the one
with the smallest counts), so what is broadcast has a fixed
size (2 x per_label x dims single-precision numbers).  The space is worked out in
a task, so that only what is broadcast passes the driver.  Whole texts are counted;
a batch of texts is cut into slices of about ``SLICE`` bytes so that memory does
not grow with it.

Defined results: a null text counts as empty, and an empty text has the zero
vector and the score of the label's share among all voters; repeated rows and
ties of similarity give the same score to the same text; labels that are null or
neither 0 nor 1 are not learned from; without any label, every score is 0.5;
further columns pass through ``score`` unchanged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mapped, others, release, slices

PER_LABEL, COLUMNS, DIMS, NEIGHBOURS, POWER, SLICE = 2_000, 2_048, 48, 25, 8.0, 2 << 20

_KINDS = bytearray(range(256))
for _b in range(256):
    c = chr(_b)
    _KINDS[_b] = ord("a") if "a" <= c <= "z" else ord("A") if "A" <= c <= "Z" else ord("0") if "0" <= c <= "9" else 0x20 if c in "\n\t\r\x0b\x0c" else _b
_KINDS[0x80:] = b"\x80" * 0x80
_KINDS[0xC3:0xCE] = b"a" * (0xCE - 0xC3)  # first bytes of Latin letters beyond ASCII
_KINDS, _LATER = bytes(_KINDS), bytes(range(0x80, 0xC0))  # a character beyond ASCII is known by its first byte


def _hashed(values: np.ndarray, columns: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % columns


def _shape_code(shape: bytes) -> int:
    out = 1469598103934665603
    for b in shape:
        out = (out ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return out


def counts(texts: list[str | None], columns: int = COLUMNS) -> np.ndarray:
    """Damped counts of shapes, shape pairs and repetitions: one row for each text."""
    out = np.zeros((len(texts), columns), np.float32)
    for row, text in enumerate(texts):
        raw = (text or "").encode()
        if not raw.strip():
            continue
        kinds = np.frombuffer(raw.translate(_KINDS, _LATER), np.uint8)
        runs = kinds[np.flatnonzero(np.diff(kinds, prepend=0))].tobytes()
        words = pa.array(runs.split(), pa.binary()).dictionary_encode()
        if not len(words):
            continue
        codes = np.array([_shape_code(w) for w in words.dictionary.to_pylist()], np.uint64)[words.indices.to_numpy()]
        own = pa.array(raw.split(), pa.binary()).dictionary_encode().indices.to_numpy()
        with np.errstate(over="ignore"):
            pairs = codes[:-1] * np.uint64(31) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        again = int((own[1:] == own[:-1]).sum())
        half = (columns - 2) // 2
        out[row, :half] += np.bincount(_hashed(codes, half), minlength=half)
        out[row, half : 2 * half] += np.bincount(_hashed(pairs, half), minlength=half)
        out[row, -1] = again
    return np.log1p(out)


def _packed(row: np.ndarray) -> bytes:
    """The columns that are not zero, and their values."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def _unpack(packed: bytes, row: np.ndarray) -> None:
    n = len(packed) // 6
    row[np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, "<f4", n, offset=2 * n)


class Voters:
    """Labelled vectors in the latent space, and how to get there."""

    def __init__(self, found: np.ndarray, labels: list[int], dims: int = DIMS, neighbours: int = NEIGHBOURS, power: float = POWER):
        self.labels = np.array(labels, np.float32)
        self.idf = (np.log((1 + len(found)) / (1 + (found > 0).sum(axis=0))) + 1).astype(np.float32)
        weighted = _unit(found * self.idf)
        _, directions = np.linalg.eigh(weighted.T @ weighted)
        self.axes = np.ascontiguousarray(directions[:, -dims:], np.float32)
        self.vectors = _unit(weighted @ self.axes)
        self.columns, self.neighbours, self.power = found.shape[1], neighbours, power

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 among the votes, for each text."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosine = _unit(_unit(counts(texts, self.columns) * self.idf) @ self.axes) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, None).astype(np.float64) ** self.power
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1), self.labels.mean())


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, per_label: int = PER_LABEL) -> Voters:
    """Learn from labelled documents (doc_id, text; doc_id, quality) where ``learn_from`` holds.

    At most ``per_label`` rows of each label are used.  They are chosen by id
    before any text is read, the smallest of each task first.
    """
    usable = labels.select("doc_id", "quality").where(learn_from & F.col("doc_id").isNotNull())
    of = lambda q: usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    chosen = of(0).union(of(1)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE):
            made = [_packed(x) for x in counts(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["doc_id", "quality", "counts"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, q, c) for batch in batches for d, q, c in zip(*(x.to_pylist() for x in batch.columns)))
        found = np.zeros((len(rows), COLUMNS), np.float32)
        for row, (_, _, packed) in zip(found, rows):
            _unpack(packed, row)
        made = pickle.dumps(Voters(found, [q for _, q, _ in rows]))
        del rows, found
        release()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["voters"])

    # 2 x per_label ids at most, so they can be sent to every task, and their counts fit into one
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int"), "text")
    counted = texts.mapInArrow(run, "doc_id long, quality int, counts binary").groupBy("doc_id", "quality").agg(F.min("counts").alias("counts"))
    made = counted.repartition(1).mapInArrow(learned, "voters binary").collect()
    return pickle.loads(made[0].voters) if made else Voters(np.zeros((0, COLUMNS), np.float32), [])


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1, higher: label 1 is likelier)."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(voters)
    docs = docs.select(others(docs, "score"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at, SLICE):
            made = sent.value.score(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.float64())], names=[*part.schema.names, "score"])

    return mapped(docs, run, "score double")
