"""Benchmark decontamination with an Aho-Corasick automaton over normalised questions.

A text's words are runs of ASCII digits, ASCII letters in lower case and
non-ASCII characters; its normal form joins them by single blanks.  A window is
``size`` consecutive words of a benchmark item (an item with fewer is one
window).  One automaton over all windows reads each document once, and word
numbers lead back to offsets in the original text.

Memory: the automaton is built in the worker from the broadcast windows.  Their
bytes are counted first; beyond ``most_bytes`` the windows go in blocks of that
size, one pass over the documents for each block.  A pass is written before the
next begins, so no more than one automaton is held at a time.

Defined results: null, empty or markless texts have no words and no hits;
repeated rows are judged each on its own; a document repeated in full or a null
doc_id is kept; an empty benchmark hits nothing; items without words have no
window; null item_ids are left out of ``items``, though their windows hit like
others, and clashing ones are compared as text; further columns pass through
``remove_contaminated``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, internal, kept, mapped, others, slices, staged

SIZE = 10
MOST_BYTES = 4 << 20

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEPT else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text in normal form, as UTF-8."""
    return (text or "").encode("utf-8").translate(_TABLE).split()


WINDOWS = "window binary, item string"
_WINDOWS = pa.schema([("window", pa.binary()), ("item", pa.string())])


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """window (normal form between blanks), items (sorted ids as text): one row for each distinct window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normal_words(text)
                if words:
                    rows.extend((b" " + b" ".join(words[i : i + size]) + b" ", item) for i in range(max(1, len(words) - size + 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _WINDOWS.field(i).type) for i in range(2)], schema=_WINDOWS)

    rows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, WINDOWS)
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _automaton(pairs: list[tuple[bytes, list[str]]]):
    """The automaton over these windows; it takes about 50 bytes for each of theirs."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, (window, _) in enumerate(pairs):
        made.add_word(window.decode("latin-1"), (k, len(window)))
    if pairs:
        made.make_automaton()
    return made


HITS = "n_words long, spans array<struct<first_word:int,last_word:int,begin:long,end:long>>, items array<string>"
_SPAN = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])


def find_hits(text: str | None, automaton, pairs: list[tuple[bytes, list[str]]]) -> tuple[int, list[dict], list[str]]:
    """Number of words, maximal runs of hit words with their offsets in ``text``, and the items whose windows occur."""
    words = normal_words(text)
    if not words or not pairs:
        return len(words), [], []
    found = list(automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
    if not found:
        return len(words), [], []
    begins = np.cumsum([0] + [len(w) + 1 for w in words])  # of each word, and of the end, in the normal form with its first blank
    last = np.searchsorted(begins, np.array([end for end, _ in found]), side="left") - 1
    first = np.searchsorted(begins, np.array([end - (n - 1) for end, (_, n) in found]), side="left")
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last + 1, -1)
    hit = np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)
    starts, ends = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1) - 1
    wanted = set(starts.tolist()) | set(ends.tolist())
    offsets = {k: m.span() for k, m in enumerate(_ORIGINAL.finditer(text)) if k in wanted}
    spans = [{"first_word": a, "last_word": b, "begin": offsets[a][0], "end": offsets[b][1]} for a, b in zip(starts.tolist(), ends.tolist())]
    return len(words), spans, sorted({item for _, (k, _) in found for item in pairs[k][1]})


def mark(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (runs of hit words; begin and end are characters of the original) and items."""
    bounded_batches(docs.sparkSession)
    found = windows(benchmark, size).withColumn("bytes", F.length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x)))
    total = found.agg(F.sum("bytes")).first()[0] or 0
    blocks = -(-total // most_bytes) or 1
    found = found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    out = docs.select(others(docs, "n_words", "spans", "items"))
    for b in range(blocks):
        block = [(bytes(r.window), r["items"]) for r in found.where(F.col("block") == b).select("window", "items").toLocalIterator()]
        out = _one_pass(out, block, first=b == 0)
        out = out if b == blocks - 1 else staged(out, "pass")
    return out


def _one_pass(docs: DataFrame, pairs: list[tuple[bytes, list[str]]], first: bool) -> DataFrame:
    """Add the hits of these windows; after the first pass, to those that the rows already carry."""
    sent, key = docs.sparkSession.sparkContext.broadcast(pairs), uuid.uuid4().hex
    at, n_columns = docs.columns.index("text"), len(docs.columns) - (0 if first else 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept("automaton", key, lambda: _automaton(sent.value))
        for batch in slices(batches, at, keep="automaton"):
            rows = [find_hits(t, automaton, sent.value) for t in batch.column(at).to_pylist()]
            if not first:
                before = zip(*(batch.column(n_columns + i).to_pylist() for i in (1, 2)))
                rows = [(n, joined(old + new), sorted({*had, *items})) for (n, new, items), (old, had) in zip(rows, before)]
            made = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(_SPAN)), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], *made], names=[*batch.schema.names[:n_columns], "n_words", "spans", "items"])

    return mapped(docs, run, HITS, n_columns)


def joined(spans: list[dict]) -> list[dict]:
    """Spans of words in order; those that overlap or follow without a gap become one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first_word"], s["last_word"])):
        if out and s["first_word"] <= out[-1]["last_word"] + 1:
            if s["last_word"] > out[-1]["last_word"]:
                out[-1] = out[-1] | {"last_word": s["last_word"], "end": s["end"]}
        else:
            out.append(s)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents in which no window of the benchmark occurs, columns as they were."""
    row = internal(["text", "n_words", "spans", "items"], "_row")
    return mark(docs.select("text", F.struct(*others(docs)).alias(row)), benchmark, size).where(F.size("spans") == 0).select(f"{row}.*")
