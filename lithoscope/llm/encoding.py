"""Whole-text encoding with a public tokenizer, sped up by remembering units.

The vocabulary's normaliser and splitter never look across a blank or a line
feed, nor from a plain letter to a plain mark or digit or back: those are the
ends of units.  A mark that may belong to the letters after it (an apostrophe),
the bar of control tokens, and every character beyond ASCII, which may compose
with its neighbour, hold units together.  The ids of a text are the ids of its
units in order, and each distinct unit is encoded once for as long as the worker
remembers it.  Units are known by two 64-bit hashes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import kept
from .words import letters, stretch_hashes, text_bytes, word_starts

END_ID = 1
REMEMBERED = 500_000

#: Kinds of bytes: 1 a plain letter, 2 a plain mark or digit, 0 what never ends a unit.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[b for b in range(0x80) if chr(b).isalpha()]] = 1
_KINDS[[b for b in range(0x21, 0x7F) if not chr(b).isalpha() and chr(b) not in "|"]] = 2
_LINES = bytes(0x20 if b == 0x0A else b for b in range(256))
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_TABLES = [letters(1), letters(2)]


class WordEncoder:
    """Encodes batches of texts; forgets everything past ``remembered`` units."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)  # in order of keys
        self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int32)
        self.flat = np.empty(0, f"u{self.width}")

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in a row, and how many each has; a few hundred go to a call."""
        every, counts = [], []
        for at in range(0, len(units), 500):
            part = units[at : at + 500]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            every.append(np.array(got.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(part)))
        return np.concatenate(every), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, units: list[str]) -> None:
        ids, counts = self._encoded(units)
        start = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])
        at = np.searchsorted(self.keys, keys)
        for name, values in (("keys", keys), ("checks", checks), ("start", start), ("count", counts)):
            setattr(self, name, np.insert(getattr(self, name), at, values))

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes in plain form (letters of wholly plain units in lower case), starts of units, and the texts' bounds in these."""
        bounds, raw = text_bytes(texts)
        plain = np.frombuffer(bytearray(raw.tobytes().translate(_LINES)), np.uint8)
        first = word_starts(plain, bounds)
        kind = _KINDS[plain]
        first[1:] |= (kind[1:] + kind[:-1] == 3) & (kind[1:] * kind[:-1] == 2) & ~((plain[:-1] == 0x27) & (kind[1:] == 1))
        starts = np.flatnonzero(first)
        if len(starts):
            odd = np.bitwise_or.reduceat((plain >= 0x80) | (plain == 0x7C), starts)
            keep = np.repeat(odd, np.diff(starts, append=len(plain)))
            tail = plain[starts[0] :]
            tail[:] = np.where(keep, tail, _LOWER[tail])
        return plain, starts, np.searchsorted(starts, bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts in a row, each followed by the end id, and the n + 1 bounds of the texts.

        A null text counts as empty.
        """
        if len(self.keys) > self.remembered:
            self._forget()
        plain, starts, bounds = self._units(texts)
        (keys, checks), sizes = stretch_hashes(plain, starts, _TABLES)
        own, where, at = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, own)
        near = np.minimum(place, max(len(self.keys) - 1, 0))
        known = (self.keys[near] == own) if len(self.keys) else np.zeros(len(own), bool)
        fresh = where[~known]
        if len(fresh):
            raw = plain.tobytes()
            self._learn(keys[fresh], checks[fresh], [raw[a : a + n].decode() for a, n in zip(starts[fresh].tolist(), sizes[fresh].tolist())])
            place = np.searchsorted(self.keys, own)
        at = place[at]
        counts, begins, flat = self.count[at].astype(np.int64), self.start[at].astype(np.int64), self.flat
        other = np.flatnonzero(self.checks[at] != checks)
        if len(other):  # two units with one key: the second is encoded on its own
            raw = plain.tobytes()
            ids, n = self._encoded([raw[starts[k] : starts[k] + sizes[k]].decode() for k in other.tolist()])
            counts[other], begins[other] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, ids])
        ends = np.cumsum(counts)
        texts_end = np.concatenate([[0], ends])[bounds] + np.arange(len(bounds))
        ids = np.empty(texts_end[-1], np.uint32)
        ids[texts_end[1:] - 1] = END_ID
        rest = np.ones(len(ids), bool)
        rest[texts_end[1:] - 1] = False
        ids[rest] = flat[np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, texts_end


#: What ``slices`` must keep for the encoder to last from task to task.
ENCODER = "encoder"


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder: about 40 bytes for each unit that it remembers."""
    return kept(ENCODER, path, lambda: WordEncoder(path))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
