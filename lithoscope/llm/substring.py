"""Substring deduplication with suffix automata over reference shards.

Every window of ``SIZE`` words that starts in a document with a smaller doc_id
too is removed, as the maximal runs of words that such windows cover.  Windows
are judged on the input, not on what is left.

A shard of the reference is what the corpus holds around one recurring anchor
(see ``anchors``): its distinct contexts.  The shard is read in order of doc_id:
a context streams through the suffix automaton of those of smaller doc_ids, its
matching statistics say which of its windows the automaton holds, and then it is
added.  Shards are dealt to tasks instead of being sent to all of them, as the
reference is the corpus itself and has no size bound; shards of very frequent
anchors are split by the windows' contents.

Defined results: null texts and those without words have none and keep nothing;
a null doc_id is smaller than none and none is smaller than it, so that such rows
stay whole and are no reference; rows that share a doc_id are no reference to
each other; columns named like the results are replaced, others are kept; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import covered, recurring_windows, with_spans
from .common import bounded_batches, mapped, others, slices
from .words import BLANKS, word_hashes

SIZE, GRAM = 13, 4


class SuffixAutomaton:
    """Suffix automaton of several sequences; states are numbers, 0 is the start."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _state(self, length: int, link: int, arrows: dict) -> int:
        self.next.append(arrows)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        arrows, link, length = self.next, self.link, self.length
        if (known := arrows[last].get(c)) is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, c, known)
        made, at = self._state(length[last] + 1, 0, {}), last
        while at >= 0 and c not in arrows[at]:
            arrows[at][c] = made
            at = link[at]
        if at >= 0:
            there = arrows[at][c]
            link[made] = there if length[there] == length[at] + 1 else self._clone(at, c, there)
        return made

    def _clone(self, at: int, c: int, there: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = copy
        while at >= 0 and self.next[at].get(c) == there:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def statistics(self, sequence: list[int]) -> list[int]:
        """Length of the longest match that ends at each place."""
        arrows, link, length = self.next, self.link, self.length
        out, at, n = [], 0, 0
        for c in sequence:
            while at and c not in arrows[at]:
                at = link[at]
                n = length[at]
            if (to := arrows[at].get(c)) is not None:
                at, n = to, n + 1
            else:
                n = 0
            out.append(n)
        return out


def search(groups: Iterator[list[dict]]) -> Iterator[tuple[int, int, bytes]]:
    """Which windows of each context occur in contexts of smaller doc_ids, by anchor."""
    for rows in groups:
        automaton, held = SuffixAutomaton(), []
        for k, row in enumerate(rows):
            words = np.frombuffer(row["payload"], np.int64).tolist()
            if k and row["doc_id"] != rows[k - 1]["doc_id"]:
                for other in held:
                    automaton.add(other)
                held = []
            if len(automaton.next) > 1:
                hit = np.array(automaton.statistics(words)[SIZE - 1 :]) >= SIZE
                if hit.any():
                    yield row["anchor"], row["context"], np.packbits(hit).tobytes()
            held.append(words)


def remove_repeats(docs: DataFrame, joined_words: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` as it is left, n_words, n_removed and spans (runs of removed words).

    A text that loses words is what is kept, joined by single blanks; any other
    stays as it was, or with ``joined_words`` becomes its words joined so too.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(others(docs, "n_words", "n_removed", "spans"))
    find = lambda sources: recurring_windows(sources, lambda texts: word_hashes(texts, BLANKS), lambda part: part.tobytes(), SIZE, GRAM, True, search)
    joined = with_spans(docs, docs.where("doc_id is not null"), find)
    at, kept = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts, made = [], []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(kept).to_pylist()):
                words = (text or "").encode().translate(BLANKS).split(b" ")
                words = [w for w in words if w]
                if not found:
                    texts.append(b" ".join(words).decode() if joined_words else text)
                    made.append((len(words), 0, []))
                    continue
                gone = covered(len(words), [(s["first"], s["windows"], s["mask"]) for s in found], SIZE)
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
                made.append((len(words), int(gone.sum()), [{"first": a, "last": b - 1} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]))
            arrays = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(kept)]
            arrays += [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:kept], "n_words", "n_removed", "spans"])

    return mapped(joined, run, "n_words long, n_removed long, spans array<struct<first:long,last:long>>", kept)

