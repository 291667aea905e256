"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms.

Each byte covered by a ``SIZE``-byte string that also starts anywhere else is
removed; matches never cross texts, overlaps count, and strings are judged on
the input.  What recurs around an anchor (see ``anchors``) is gathered, copies
counted, and read in blocks: a block holds the distinct contexts of some anchors,
cut into shards.

A shard's suffixes are sorted once, by prefix doubling over symbols: a symbol is
the hash of ``STEP`` bytes and the next one is ``STEP`` bytes on, so a string of
``SIZE`` bytes is ``SIZE / STEP`` symbols.  The transforms of the shards are
merged without sorting their suffixes again (Holt and McMillan, 2014): beginning
with one shard after the other, each pass reads the interleave, puts the shard of
every preceding symbol into the bucket of that symbol, and so has the interleave
refined by one symbol.  Places between which a pass finds a first difference have
common prefixes of that many symbols; after ``SIZE / STEP`` passes what is not
told apart is an interval of equal strings.  An interval with two occurrences or
more, copies counted, is a repeat.

Defined results: a null text has no bytes; a text shorter than a string keeps
all; repeated rows are occurrences of their own; a null doc_id is a document like
any other; columns named like the results are replaced, others are kept; an empty
table gives no rows.  Texts are kept whole as bytes, as a cut may fall inside a
character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import _BYTES, covered, recurring_windows, with_spans
from .common import bounded_batches, mapped, others, slices
from .words import mixed, text_bytes

SIZE, GRAM, STEP = 200, 64, 40
BLOCK_BYTES, SHARD_BYTES = 1 << 20, 1 << 18


def symbols(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of the ``STEP`` bytes from each place on (from 1), 0 where they would pass the end; ``ends``: of each place's context."""
    n = len(raw)
    place = np.arange(n)
    if n < STEP:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        hashes, step, factor = _BYTES[raw], 1, 0xD6E8FEB86659FD93
        while step < STEP // 5:  # 8, then five of those
            hashes = hashes[:-step] * np.uint64(factor) + hashes[step:]
            step, factor = step * 2, factor * factor % (1 << 64)
        m = n - STEP + 1
        whole = hashes[:m].copy()
        for k in range(1, 5):
            whole = mixed(whole) * np.uint64(3) + hashes[8 * k : 8 * k + m]
    out = np.zeros(n, np.int64)
    real = place[:m][place[:m] + STEP <= ends[:m]]
    out[real] = np.unique(whole[real], return_inverse=True)[1] + 1
    return out


def suffix_order(symbol: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of a shard in the order of their suffixes, shorter before longer, equal ones by place."""
    n, place = len(symbol), np.arange(len(symbol))
    rank, reach = symbol, STEP
    longest = int((ends - place).max(initial=0))
    while reach <= longest:
        after = np.where(place + reach <= ends, rank[np.minimum(place + reach, n - 1)], 0)
        rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1]
        reach *= 2
    return np.argsort(rank * n + place)


def merged(symbol: np.ndarray, begins: np.ndarray, ends: np.ndarray, cuts: list[int], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all shards in the order of their first ``passes`` symbols, and a number for each run of equal ones.

    ``begins``, ``ends``: of each place's context; ``cuts``: bounds of the shards, which hold whole contexts.
    """
    orders, transforms = [], []
    for a, b in zip(cuts, cuts[1:]):
        order = suffix_order(symbol[a:b], ends[a:b] - a) + a
        orders.append(order)
        before = order - STEP
        transforms.append(np.where(before >= begins[order], symbol[np.maximum(before, 0)], -1))
    shard = np.repeat(np.arange(len(orders)), [len(o) for o in orders])
    interval = np.zeros(len(shard), np.int64)
    # suffixes without a whole symbol have no successor to come from: they stay in front, by shard
    bare = np.repeat(np.arange(len(orders)), [int((symbol[a:b] == 0).sum()) for a, b in zip(cuts, cuts[1:])])
    for _ in range(passes):
        preceding = np.empty(len(shard), np.int64)
        for s, transform in enumerate(transforms):
            preceding[shard == s] = transform
        from_ = np.flatnonzero(preceding > 0)
        bucket = np.argsort(preceding[from_] * (1 << 32) + np.arange(len(from_)))
        key, source = preceding[from_][bucket], interval[from_][bucket]
        new = (np.diff(key, prepend=-1) != 0) | (np.diff(source, prepend=-1) != 0)
        shard = np.concatenate([bare, shard[from_][bucket]])
        interval = np.concatenate([np.zeros(len(bare), np.int64), np.cumsum(new)])
    place = np.empty(len(shard), np.int64)
    for s, order in enumerate(orders):
        place[shard == s] = order
    return place, interval


def block_masks(rows: list[dict]) -> Iterator[tuple[int, int, bytes]]:
    """Which windows of the contexts of a block occur twice or more in it."""
    raw = np.frombuffer(b"".join(r["payload"] + b"\0" for r in rows), np.uint8)  # a place for the empty suffix after each
    sizes = np.array([len(r["payload"]) + 1 for r in rows])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), sizes)
    begins, ends = begin[owner], (begin + sizes - 1)[owner]
    cuts = [0, *(begin[1:][np.diff(begin // SHARD_BYTES) > 0]).tolist(), len(raw)]
    place, interval = merged(symbols(raw, ends), begins, ends, cuts, SIZE // STEP)
    windows, copies = np.array([r["windows"] for r in rows]), np.array([r["n"] for r in rows])
    starts = place - begins[place] < windows[owner[place]]
    times = np.bincount(interval[starts], copies[owner[place[starts]]])
    hit = np.zeros(len(raw), bool)
    hit[place[starts]] = times[interval[starts]] >= 2
    for k, row in enumerate(rows):
        own = hit[begin[k] : begin[k] + row["windows"]]
        if own.any():
            yield row["anchor"], row["context"], np.packbits(own).tobytes()


def search(groups: Iterator[list[dict]]) -> Iterator[tuple[int, int, bytes]]:
    """Whole anchors are put together to blocks; equal windows have one anchor, so none are in two blocks."""
    block, held = [], 0
    for rows in groups:
        block += rows
        held += sum(len(r["payload"]) for r in rows)
        if held >= BLOCK_BYTES:
            yield from block_masks(block)
            block, held = [], 0
    if block:
        yield from block_masks(block)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with kept (bytes), n_bytes, n_removed and spans (begin, end of each removed run, in bytes)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(others(docs, "kept", "n_bytes", "n_removed", "spans"))
    joined = with_spans(docs, docs, lambda sources: recurring_windows(sources, text_bytes, lambda part: part.tobytes(), SIZE, GRAM, False, search))
    at, n_columns = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            made = []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(n_columns).to_pylist()):
                raw = (text or "").encode()
                if not found:
                    made.append((raw, len(raw), 0, []))
                    continue
                gone = covered(len(raw), [(s["first"], s["windows"], s["mask"]) for s in found], SIZE)
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                made.append((np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), [{"begin": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            arrays = [batch.column(i) for i in range(n_columns)] + [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:n_columns], "kept", "n_bytes", "n_removed", "spans"])

    return mapped(joined, run, "kept binary, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>", n_columns)
