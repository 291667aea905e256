"""Words of a batch of texts as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Byte tables: blanks of the contracts (20 and 09 to 0D) become a space; the second puts A-Z in lower case too.
BLANKS = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
BLANKS_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else BLANKS[b] for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _K2
        x = (x ^ (x >> np.uint64(27))) * _K3
        return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts and their bytes in a row; null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return bounds - bounds[0], raw[bounds[0] : bounds[-1]]


#: Words up to this many bytes are summed up byte by byte, longer ones hashed one at a time; bytes looked at together.
SHORT, STRETCH = 48, 1 << 17
_POWERS = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(SHORT, _K1))])


def letters(seed: int) -> np.ndarray:
    """A number for each byte, none for a space."""
    with np.errstate(over="ignore"):
        out = mixed(np.arange(1, 257, dtype=np.uint64) * _K2 + np.uint64(seed))
    out[0x20] = 0
    return out


def stretch_hashes(plain: np.ndarray, starts: np.ndarray, tables: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the stretches of bytes from each start to the next, spaces left out, one for each table of ``letters``, and their sizes.

    Spaces stand at the end of a stretch only.
    """
    out, sizes = [np.empty(len(starts), np.uint64) for _ in tables], np.empty(len(starts), np.int64)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(plain) + STRETCH, STRETCH)))
    with np.errstate(over="ignore"):
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            begin, end = int(starts[a]), int(starts[b]) if b < len(starts) else len(plain)
            own, part = starts[a:b] - begin, plain[begin:end]
            since = np.arange(end - begin) - np.repeat(own, np.diff(own, append=end - begin))
            sizes[a:b] = np.add.reduceat((part != 0x20).astype(np.int64), own)
            weights = _POWERS[np.minimum(since, SHORT)]
            for hashes, table in zip(out, tables):
                hashes[a:b] = np.add.reduceat(table[part] * weights, own)
        out = [mixed(hashes + sizes.astype(np.uint64) * _K3) for hashes in out]
    for k in np.flatnonzero(sizes > SHORT).tolist():
        for seed, hashes in enumerate(out):
            hashes[k] = xxhash.xxh3_64_intdigest(plain[starts[k] : starts[k] + sizes[k]], seed)
    return out, sizes


def word_starts(plain: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte: one that is no space, after a space or at the front of a text."""
    real = plain != 0x20
    first = real.copy()
    first[1:] &= ~real[:-1]
    at = bounds[:-1][bounds[:-1] < len(plain)]
    first[at] = real[at]
    return first


_LETTERS = letters(1)


def word_hashes(texts: pa.Array, table: bytes = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts (n + 1) in the list of all their words, and the words' hashes; null texts have none."""
    bounds, raw = text_bytes(texts)
    plain = np.frombuffer(raw.tobytes().translate(table), np.uint8)
    starts = np.flatnonzero(word_starts(plain, bounds))
    (hashes,), _ = stretch_hashes(plain, starts, [_LETTERS])
    return np.searchsorted(starts, bounds), hashes


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; the last size - 1 places are left out."""
    n = max(0, len(hashes) - size + 1)
    with np.errstate(over="ignore"):
        out = hashes[:n] * _K1 + np.uint64(size)
        for k in range(1, size):
            out = mixed(out) * _K1 + hashes[k : n + k]
        return mixed(out)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, ASCII letters in lower case; fewer words than ``size`` are one shingle."""
    bounds, hashes = word_hashes(texts, BLANKS_LOWER)
    every, out = grams(hashes, size), []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= size:
            own = np.sort(every[a : b - size + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        else:
            out.append(grams(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
