"""Language of texts by a bidirectional gated recurrent network over bytes.

The normal form of a text keeps ASCII letters in lower case and all bytes beyond
ASCII; everything else is a blank.  A window is a run between blanks (longer runs
are cut between characters, ``LONGEST`` bytes at most in a piece).  The network reads a window's bytes from both
sides, gives every position a probability for each language, and a document's
probabilities are the geometric mean over all its positions, normalised.  It is
trained here by backpropagation through time, with Adam, in numpy.

As a window's reading depends on nothing outside it, each distinct window of a
worker is read once for as long as the worker remembers it (``REMEMBERED``).

Bounds: training uses ``PER_LANGUAGE`` documents of each language, those with the
smallest hashes of their ids, and all of their windows.  Prediction reads every
byte of every text.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if there was nothing to learn from; rows whose lang is null
are not learned from; repeated rows get the same answer; ties go to the first
language in alphabetical order; further columns pass through ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, mapped, others, slices
from .words import text_bytes

UNDETERMINED = "und"
HIDDEN, LONGEST, REMEMBERED = 16, 64, 400_000
PER_LANGUAGE, EPOCHS, BATCH, RATE, SEED = 60, 3, 256, 0.01, 9

_NORMAL = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Reader:
    """The network: for each direction a table of inputs, recurrent weights and a bias; one output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        size = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.weights = {}
        for way in "fb":
            self.weights |= {f"x{way}": size(256, 3 * hidden), f"u{way}": size(hidden, 3 * hidden) * 0.6, f"c{way}": np.zeros(3 * hidden, np.float32)}
        self.weights |= {"o": size(2 * hidden, len(languages)), "b": np.zeros(len(languages), np.float32)}

    def _run(self, codes: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """States after each step (steps, windows, hidden) and what the way back needs."""
        h, n = self.hidden, codes.shape[1]
        x, u, c = (self.weights[k + way] for k in "xuc")
        state, states, trail = np.zeros((n, h), np.float32), np.empty((len(codes), n, h), np.float32), []
        for t, code in enumerate(codes):
            inp, rec = x[code] + c, state @ u
            gates = _sigmoid(inp[:, : 2 * h] + rec[:, : 2 * h])
            r, z = gates[:, :h], gates[:, h:]
            new = np.tanh(inp[:, 2 * h :] + r * rec[:, 2 * h :])
            trail.append((state, r, z, new, rec[:, 2 * h :]))
            state = new + z * (state - new)
            states[t] = state
        return states, trail

    def _output(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Log probabilities of each position."""
        h = self.hidden
        logit = forward @ self.weights["o"][:h] + backward[::-1] @ self.weights["o"][h:] + self.weights["b"]
        logit -= logit.max(axis=2, keepdims=True)
        return logit - np.log(np.exp(logit).sum(axis=2, keepdims=True))

    def read(self, codes: np.ndarray) -> np.ndarray:
        """Sum of log probabilities over positions, for windows of one length (steps, windows)."""
        return self._output(self._states(codes, "f"), self._states(codes[::-1], "b")).sum(axis=0)

    def _states(self, codes: np.ndarray, way: str) -> np.ndarray:
        """As ``_run``, without the trail, features before windows, and half-angles folded into the weights."""
        h, n = self.hidden, codes.shape[1]
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * h, h])[:, None]
        x, u = (self.weights["x" + way] + self.weights["c" + way]).T * half, np.ascontiguousarray(self.weights["u" + way].T * half)
        states, state = np.empty((len(codes), h, n), np.float32), np.zeros((h, n), np.float32)
        for t, code in enumerate(codes):
            inp, rec = np.take(x, code, axis=1), u @ state
            gates = np.tanh(inp[: 2 * h] + rec[: 2 * h])
            r, z = gates[:h], gates[h:]
            rec = rec[2 * h :]
            new = np.tanh(inp[2 * h :] + (r * rec + rec) * np.float32(0.5))
            state = np.multiply(new + state + z * (state - new), np.float32(0.5), out=states[t])
        return states.transpose(0, 2, 1)

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions; ``target``: a language number for each window."""
        h, steps, n = self.hidden, *codes.shape
        f, ftrail = self._run(codes, "f")
        b, btrail = self._run(codes[::-1], "b")
        d = np.exp(self._output(f, b))
        d[:, np.arange(n), target] -= 1
        d /= steps * n
        back = b[::-1]
        out = {"o": np.concatenate([np.einsum("tnh,tnl->hl", f, d), np.einsum("tnh,tnl->hl", back, d)]), "b": d.sum(axis=(0, 1))}
        out |= self._back(codes, ftrail, d @ self.weights["o"][:h].T, "f")
        return out | self._back(codes[::-1], btrail, (d @ self.weights["o"][h:].T)[::-1], "b")

    def _back(self, codes: np.ndarray, trail: list, above: np.ndarray, way: str) -> dict[str, np.ndarray]:
        h, u = self.hidden, self.weights["u" + way]
        dx, du, dc = np.zeros((256, 3 * h), np.float32), np.zeros_like(u), np.zeros(3 * h, np.float32)
        carry = np.zeros_like(above[0])
        for t in range(len(codes) - 1, -1, -1):
            state, r, z, new, rec = trail[t]
            dh = above[t] + carry
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (state - new) * z * (1 - z)
            dr = dnew * rec * r * (1 - r)
            gates = np.concatenate([dr, dz, dnew], axis=1)
            through = np.concatenate([dr, dz, dnew * r], axis=1)
            du += state.T @ through
            dc += gates.sum(axis=0)
            np.add.at(dx, codes[t], gates)
            carry = dh * z + through @ u.T
        return {"x" + way: dx, "u" + way: du, "c" + way: dc}


def train(windows: list[bytes], labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Reader:
    """Windows of one length go together in a batch; batches come in random order."""
    net, rng = Reader(languages, HIDDEN), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second, step = {k: np.zeros_like(v) for k, v in net.weights.items()}, 0
    lengths = np.array([len(w) for w in windows])
    for _ in range(epochs):
        batches = []
        for n in np.unique(lengths):
            own = rng.permutation(np.flatnonzero(lengths == n))
            batches += [own[i : i + BATCH] for i in range(0, len(own), BATCH)]
        for k in rng.permutation(len(batches)):
            codes = np.frombuffer(b"".join(windows[i] for i in batches[k]), np.uint8).reshape(len(batches[k]), -1).T
            step += 1
            for name, g in net.gradients(codes, labels[batches[k]]).items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                net.weights[name] -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return net


def pieces(window: bytes) -> list[bytes]:
    """A window in pieces of ``LONGEST`` bytes at most, cut between characters."""
    out, at = [], 0
    while at < len(window):
        end = min(at + LONGEST, len(window))
        while end < len(window) and end > at + 1 and 0x80 <= window[end] < 0xC0:
            end -= 1
        out.append(window[at:end])
        at = end
    return out


def normal_windows(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Bounds of the texts in the list of all windows, and that list (empty windows included)."""
    bounds, raw = text_bytes(texts)
    plain = pa.py_buffer(raw.tobytes().translate(_NORMAL))
    split = pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(bounds)), plain), " ")
    ends = split.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()


class Memory:
    """What the network says about windows already read."""

    def __init__(self, net: Reader):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        n = len(self.net.languages)
        self.slots: dict[str, int] = {"": 0}
        self.sums, self.sizes, self.letters = np.zeros((1024, n), np.float32), np.zeros(1024, np.int64), np.zeros(1024, bool)

    def slots_of(self, names: list[str]) -> np.ndarray:
        if len(self.slots) > REMEMBERED:
            self._forget()
        fresh = [w for w in names if w not in self.slots]
        if fresh:
            begin = len(self.slots)
            self.slots.update(zip(fresh, range(begin, begin + len(fresh))))
            while len(self.slots) > len(self.sizes):
                self.sums, self.sizes, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.sizes, self.letters))
            self._read(fresh, begin)
        return np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))

    def _read(self, names: list[str], begin: int) -> None:
        raw = [w.encode() for w in names]
        self.letters[begin : begin + len(names)] = [any(map(str.isalpha, w)) for w in names]
        self.sizes[begin : begin + len(names)] = list(map(len, raw))
        parts = [(len(piece), begin + k, piece) for k, w in enumerate(raw) for piece in pieces(w)]
        parts.sort(key=lambda p: p[0])
        lengths, owners = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        for n in np.unique(lengths):
            lo, hi = np.searchsorted(lengths, [n, n + 1])
            for at in range(lo, hi, 1024):
                end = min(at + 1024, hi)
                codes = np.frombuffer(b"".join(p[2] for p in parts[at:end]), np.uint8).reshape(end - at, n).T
                np.add.at(self.sums, owners[at:end], self.net.read(codes))

    def documents(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each text."""
        bounds, words = normal_windows(texts)
        at = self.slots_of(words.dictionary.to_pylist())[words.indices.to_numpy()]
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        n = len(bounds) - 1
        total = np.stack([np.bincount(owner, self.sums[at, k], minlength=n) for k in range(len(self.net.languages))], axis=1)
        size = np.bincount(owner, self.sizes[at], minlength=n)
        mean = total / np.maximum(size, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        known = np.bincount(owner, self.letters[at], minlength=n) > 0
        best = p.argmax(axis=1)
        return [self.net.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, p.max(axis=1), 0.0)


def fit(docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE) -> Reader | None:
    """Learn from documents (doc_id, text, lang) where ``learn_from`` holds; None if there are none."""
    bounded_batches(docs.sparkSession)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.select("doc_id", "lang").where(learn_from & F.col("lang").isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            bounds, words = normal_windows(batch.column(1))
            names, at, rows = words.dictionary.to_pylist(), words.indices.to_numpy(), []
            for k, lang in enumerate(batch.column(0).to_pylist()):
                own = [w for w in (names[i] for i in at[bounds[k] : bounds[k + 1]]) if w]
                rows += [(lang, piece) for w in own for piece in pieces(w.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "piece"])

    # per_language ids of each language, so they can be sent to every task
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"]).select("lang", "text")
    rows = sorted((r.lang, bytes(r.piece)) for r in texts.mapInArrow(run, "lang string, piece binary").collect())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    return train([r[1] for r in rows], np.array([number[r[0]] for r in rows]), languages)


def predict(docs: DataFrame, net: Reader | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(others(docs, "lang_pred", "score"))
    if net is None:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    sent, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(sent.value)
        for batch in slices(batches, at):
            langs, score = memory.documents(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return mapped(docs, run, "lang_pred string, score double")
