"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count c is held as the level 1 + floor(log c) to base 1.5: the events (n-gram, 1)
to (n-gram, level) are members of a Bloom filter.  Reading asks for event after
event until one is missing; a level stands for the mean of its counts.  A filter
never reads a count's level too low; it reads one too high where bits of others
happen to be set (about 1 in 200 n-grams that were never seen).  An n-gram counts
no more than its context does, whatever the filter says.

Smoothing: an n-gram's probability is (count + m p) / (count of its context + m),
p being that of the n-gram without its first token; single tokens have exact
counts, with 0.1 added.  Contexts at the front of a document begin with a mark.

Everything is cut into blocks by the hash of n-grams, as many as the corpus has
4 MB of text: a task takes the parts of all counts that fall into a block, adds
them up and sets its bits (16 for each event), so that the filter grows with the
corpus and no task does.  Up to ``most_bytes`` (measured first) the blocks are
broadcast as one filter.  Beyond, n-grams go to the blocks: packs of documents are
written once as hashes of words; the distinct n-grams of a pack meet their blocks,
and the levels come back to the pack, one byte each.  Both ways give the same
scores.

Words are told apart by 64-bit hashes; two of n words share one with probability
n^2 / 2^65.  In a block, n-grams are told apart by 32 bits more.

Defined results: a null or empty text is its end alone, one token; repeated rows
are scored, and counted, each on its own; a row where ``learn`` is null is not
learned from; with nothing learned N and V are 0, and no token is known; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, groups, partitions, release, slices
from .words import BLANKS_LOWER, mixed, word_hashes

#: Order of the model, weight of shorter n-grams, and what is added to a token's count.
ORDER, WEIGHT, ADDED = 2, 128.0, 0.1
BASE, EVENT_BITS, BLOCK_BYTES = 1.5, 16, 4 << 20
#: Largest filter, with its words, that is broadcast; tokens of documents that are worked on together.
MOST_BYTES, PACK = 32 << 20, 1 << 21
END, BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_K = np.uint64(0x9E3779B97F4A7C15)
_MEANS = np.array([0.0] + [(np.ceil(BASE ** (j - 1)) + np.ceil(BASE**j) - 1) / 2 for j in range(1, 100)])
_PARTS = "block int, words binary, word_counts binary, ones binary, more binary, counts binary"
_FILTER = "block int, words binary, word_counts binary, bits binary, n_words long, n_tokens long"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts in the list of all their tokens, and the tokens: hashes of words, and one end a text."""
    bounds, words = word_hashes(texts, BLANKS_LOWER)
    return bounds + np.arange(len(bounds)), np.insert(words, bounds[1:], END)


def grams(found: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens that end at each place; marks stand before a text."""
    since = np.arange(len(found)) - np.repeat(bounds[:-1], np.diff(bounds))
    with np.errstate(over="ignore"):
        out = np.full(len(found), np.uint64(size))
        for back in range(size - 1, -1, -1):
            own = found if not back else np.concatenate([np.full(min(back, len(found)), BEGIN), found[:-back]])
            out = mixed(out * _K + np.where(since >= back, own, BEGIN))
    return out


def blocks_of(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)).astype(np.int64)


def placed(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of each n-gram in the high half, and in the low one what tells those of a block apart."""
    return blocks_of(hashes, n_blocks).astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def rests(places: np.ndarray) -> np.ndarray:
    return places.astype(np.uint32)


def squeezed(keys: np.ndarray) -> bytes:
    """Ascending keys: their differences, first bytes of all before second ones, compressed; the high ones are nearly all 0."""
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(keys), keys.itemsize).T).tobytes(), 1)


def spread(data: bytes, kind: type) -> np.ndarray:
    """The keys that were ``squeezed``."""
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log c), from integers alone, so that it is the same everywhere."""
    edges = np.ceil(BASE ** np.arange(100)).astype(np.float64)
    return np.searchsorted(edges, counts.astype(np.float64), side="right")


def _events(rest: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """For the event (n-gram, level): 32 bits that choose a word of the filter, and four bits in it."""
    with np.errstate(over="ignore"):
        h = mixed(rest.astype(np.uint64) + np.asarray(level, np.uint64) * _K)
    bits = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return h >> np.uint64(32), bits


def made_filter(rest: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words of a block's filter for n-grams and their counts."""
    level = levels_of(counts)
    size = -(-int(level.sum()) * EVENT_BITS // 64)
    out = np.zeros(size, np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        place, bits = _events(rest[level >= j], j)
        np.bitwise_or.at(out, ((place * np.uint64(size)) >> np.uint64(32)).astype(np.int64), bits)
    return out


class Filter:
    """Blocks of a filter side by side, and the exact counts of words."""

    def __init__(self, blocks: list[int], bits: list[np.ndarray], words: list[np.ndarray], counts: list[np.ndarray], n_blocks: int):
        self.n_blocks = n_blocks
        self.size, self.start = np.zeros(n_blocks, np.int64), np.zeros(n_blocks, np.int64)
        at = 0
        for b, own in zip(blocks, bits):
            self.size[b], self.start[b] = len(own), at
            at += len(own)
        self.bits = np.concatenate([*bits, np.zeros(0, np.uint64)])
        keys, found = np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
        order = np.argsort(keys)
        self.words, self.counts = keys[order], found[order]

    def levels(self, places: np.ndarray) -> np.ndarray:
        """The level that the filter gives each n-gram, 0 where it was never seen."""
        out, rest, block = np.zeros(len(places), np.uint8), rests(places), (places >> np.uint64(32)).astype(np.int64)
        size, start = self.size[block], self.start[block]
        left, j = np.flatnonzero(size), 1
        while len(left) and j < len(_MEANS):
            place, bits = _events(rest[left], j)
            at = start[left] + ((place * size[left].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            left = left[self.bits[at] & bits == bits]
            out[left] = j
            j += 1
        return out

    def word_counts(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, self.counts[at], 0)


def scores(found: np.ndarray, bounds: np.ndarray, counts: np.ndarray, ends: int, levels: list[np.ndarray], n: int, v: int, weight: float) -> tuple[np.ndarray, ...]:
    """By text: tokens, tokens known, base score, score; ``counts`` and ``levels`` (orders 2 and up) by token."""
    base = (counts + ADDED) / (n + ADDED * (v + 1))
    p, since = base, np.arange(len(found)) - np.repeat(bounds[:-1], np.diff(bounds))
    shorter = counts.astype(np.float64)
    for level in levels:
        # the context is the n-gram of one token less that ends one place before; at the front it is the mark
        context = np.where(since == 0, float(ends), np.concatenate([[0.0], shorter[:-1]]))
        count = np.minimum(np.minimum(_MEANS[level], shorter), context)
        p = (count + weight * p) / (context + weight)
        shorter = count
    sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has its end
    return np.diff(bounds), sums((counts > 0).astype(np.int64)), sums(np.log10(base)), sums(np.log10(p))


@dataclass
class Model:
    """A fitted model: its filter as a table of blocks, and what was learned."""

    blocks: DataFrame
    n_blocks: int
    order: int
    n_tokens: int
    n_words: int
    n_bytes: int
    scratch: Scratch


def _by_block(*own: np.ndarray) -> Iterator[tuple]:
    """For each block that occurs in some of the arrays (each ascending): its number and its slice of each."""
    present = np.unique(np.concatenate(own))
    ends = [(np.searchsorted(o, present).tolist(), np.searchsorted(o, present, side="right").tolist()) for o in own]
    for k, block in enumerate(present.tolist()):
        yield block, *[slice(a[k], b[k]) for a, b in ends]


def fit(docs: DataFrame, learn: Column, order: int = ORDER) -> Model:
    """Count the n-grams of the rows of ``docs`` (text) where ``learn`` holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ngrams")
    learned = docs.where(learn).select(F.col("text").cast("string").alias("text"))
    n_bytes = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, n_bytes // BLOCK_BYTES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def parts() -> pa.RecordBatch:
            words, word_counts = np.unique(np.concatenate([t for _, t in held]), return_counts=True)
            found, counts = np.unique(np.concatenate([placed(grams(t, b, k), n_blocks) for b, t in held for k in range(2, order + 1)] or [np.zeros(0, np.uint64)]), return_counts=True)
            # blocks are ranges of hashes, so words in order are in order of blocks; most n-grams come once, and need no count
            once, word_counts = counts == 1, word_counts.astype(np.uint32)
            ones, more, counts = found[once], found[~once], counts[~once].astype(np.uint32)
            rows = [
                (block, squeezed(words[w]), zstandard.compress(word_counts[w].tobytes(), 1), squeezed(rests(ones[a])), squeezed(rests(more[b])), zstandard.compress(counts[b].tobytes(), 1))
                for block, w, a, b in _by_block(blocks_of(words, n_blocks), ones >> np.uint64(32), more >> np.uint64(32))
            ]
            names = ["block", "words", "word_counts", "ones", "more", "counts"]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "block" else pa.binary()) for n, x in zip(names, zip(*rows))], names=names)

        size = 0
        for batch in slices(batches, 0):
            bounds, found = tokens(batch.column(0))
            held.append((bounds, found))
            size += len(found)
            if size >= PACK:
                yield parts()
                held, size = [], 0
        if held:
            yield parts()

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, ["block"]):
            column = lambda name, own=own: own.column(own.schema.get_field_index(name)).to_pylist()
            keys = lambda name, kind: np.concatenate([spread(x, kind) for x in column(name)])
            numbers = lambda name: np.frombuffer(b"".join(map(zstandard.decompress, column(name))), np.uint32).astype(np.int64)
            words, word_counts = totals(keys("words", np.uint64), numbers("word_counts"))
            ones, more = keys("ones", np.uint32), keys("more", np.uint32)
            rest, counts = totals(np.concatenate([ones, more]), np.concatenate([np.ones(len(ones), np.int64), numbers("counts")]))
            row = [own.column(0)[0].as_py(), words.tobytes(), word_counts.tobytes(), made_filter(rest, counts).tobytes(), len(words), int(word_counts.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["block", "words", "word_counts", "bits", "n_words", "n_tokens"])
        release()

    parts = learned.mapInArrow(counted, _PARTS).repartition(min(n_blocks, 8 * partitions(spark)), "block").sortWithinPartitions("block")
    blocks = scratch.staged(parts.mapInArrow(built, _FILTER), "filter")
    size = sum((F.octet_length(c) for c in ("words", "word_counts", "bits")), F.lit(0).cast("long"))
    found = blocks.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum(size)).first()
    return Model(blocks, n_blocks, order, *(x or 0 for x in found), scratch)


def _loaded(rows: list, n_blocks: int) -> Filter:
    arrays = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
    return Filter([r["block"] for r in rows], arrays("bits", np.uint64), arrays("words", np.uint64), arrays("word_counts", np.int64), n_blocks)


def _result(ids: pa.Array, columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["id", "n_tokens", "n_known", "base_score", "score"])


def _word_counts(found: np.ndarray, ask) -> np.ndarray:
    """Counts by token, asked for each distinct one, in order."""
    keys, back = np.unique(found, return_inverse=True)
    return ask(keys)[back]


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", weight: float = WEIGHT, most_bytes: int = MOST_BYTES) -> DataFrame:
    """id, n_tokens, n_known, base_score, score for every row of ``docs`` (text and the column of ids)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col("`" + id_column.replace("`", "``") + "`").alias("id"), F.col("text").cast("string").alias("text"))
    schema = f"id {kind}, n_tokens long, n_known long, base_score double, score double"
    n, v, order = model.n_tokens, model.n_words, model.order
    if model.n_bytes > most_bytes:
        return _routed(rows, model, weight, schema)
    # bounded by most_bytes
    sent = model.scratch.broadcast(_loaded(model.blocks.collect(), model.n_blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sent.value
        ends = int(whole.word_counts(np.array([END]))[0])
        for batch in slices(batches, 1):
            bounds, found = tokens(batch.column(1))
            levels = [whole.levels(placed(grams(found, bounds, k), whole.n_blocks)) for k in range(2, order + 1)]
            yield _result(batch.column(0), scores(found, bounds, _word_counts(found, whole.word_counts), ends, levels, n, v, weight))

    return rows.mapInArrow(run, schema)


def _asked(found: np.ndarray, bounds: np.ndarray, order: int, n_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and places of n-grams of a pack in order, so in order of blocks, and where each token's stand among them."""
    words, at_word = np.unique(found, return_inverse=True)
    every = np.concatenate([np.zeros(0, np.uint64), *[placed(grams(found, bounds, k), n_blocks) for k in range(2, order + 1)]])
    asked, at_gram = np.unique(every, return_inverse=True)
    return words, at_word, asked, at_gram


def _routed(rows: DataFrame, model: Model, weight: float, schema: str) -> DataFrame:
    """Scores where n-grams go to the blocks of the filter and levels come back."""
    spark, scratch = rows.sparkSession, model.scratch
    n, v, order, n_blocks = model.n_tokens, model.n_words, model.order, model.n_blocks
    id_type = rows.schema["id"].dataType
    ends = model.blocks.where(F.col("block") == int(blocks_of(np.array([END]), n_blocks)[0]))
    ends = sum(int(_loaded([r], n_blocks).word_counts(np.array([END]))[0]) for r in ends.collect())  # one row

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def pack() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            sizes = np.concatenate([np.diff(x[1]) for x in held])
            words = zstandard.compress(np.concatenate([x[2] for x in held]).tobytes(), 3)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([words], pa.binary())], names=["ids", "sizes", "words"])

        size = 0
        for batch in slices(batches, 1):
            bounds, found = tokens(batch.column(1))
            held.append((batch.column(0), bounds, found))
            size += len(found)
            if size >= PACK:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    packs = rows.mapInArrow(packed, f"ids array<{id_type.simpleString()}>, sizes array<long>, words binary")
    packs = scratch.staged(packs.withColumn("pack", F.monotonically_increasing_id()), "packs")

    def opened(words: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(zstandard.decompress(words), np.uint64), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, bounds = opened(row["words"], row["sizes"])
                words, _, asked, _ = _asked(found, bounds, order, n_blocks)
                out = [(block, squeezed(words[w]), squeezed(rests(asked[a]))) for block, w, a in _by_block(blocks_of(words, n_blocks), asked >> np.uint64(32))]
                blocks, of_words, of_grams = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([row["pack"]] * len(out), pa.int64()), pa.array(of_words, pa.binary()), pa.array(of_grams, pa.binary())], names=["block", "pack", "words", "rest"])
        release()

    asks = packs.select("pack", "sizes", "words").mapInArrow(asking, "block int, pack long, words binary, rest binary")
    none = F.lit(None).cast("binary")
    there = model.blocks.select("block", F.lit(None).cast("long").alias("pack"), "words", none.alias("rest"), "word_counts", "bits")
    both = asks.select("*", none.alias("word_counts"), none.alias("bits")).union(there)
    both = both.repartition(min(n_blocks, 8 * partitions(spark)), "block").sortWithinPartitions("block", F.col("pack").asc_nulls_first())

    def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["pack"] is None:
                    at, own = row["block"], _loaded([row], n_blocks)
                    continue
                if at != row["block"]:  # nothing was learned that falls into this block
                    at, own = row["block"], _loaded([], n_blocks)
                levels = own.levels(np.uint64(row["block"] << 32) | spread(row["rest"], np.uint32).astype(np.uint64))
                counts = own.word_counts(spread(row["words"], np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([row["pack"]], pa.int64()), pa.array([row["block"]], pa.int32()), pa.array([zstandard.compress(counts.tobytes(), 3)], pa.binary()), pa.array([zstandard.compress(levels.tobytes(), 3)], pa.binary())], names=["pack", "block", "counts", "levels"])

    answers = both.mapInArrow(answering, "pack long, block int, counts binary, levels binary")
    spare = packs.select("pack", F.lit(-1).alias("block"), none.alias("counts"), none.alias("levels"), "ids", "sizes", "words")
    back = answers.select("*", F.lit(None).cast(f"array<{id_type.simpleString()}>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes"), none.alias("words")).union(spare)
    back = back.repartition(partitions(spark), "pack").sortWithinPartitions("pack", "block")

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, ["pack"]):
            get = lambda name, own=own: own.column(own.schema.get_field_index(name))
            ids, sizes, words = get("ids")[:1].flatten(), get("sizes")[0].as_py(), get("words")[0].as_py()
            found, bounds = opened(words, sizes)
            whole = lambda name, kind: np.frombuffer(b"".join(zstandard.decompress(x) for x in get(name)[1:].to_pylist()), kind)
            _, at_word, _, at_gram = _asked(found, bounds, order, n_blocks)
            levels = whole("levels", np.uint8)[at_gram].reshape(order - 1, -1)
            yield _result(ids, scores(found, bounds, whole("counts", np.int64)[at_word], ends, list(levels), n, v, weight))
        release()

    return back.mapInArrow(scoring, schema)
