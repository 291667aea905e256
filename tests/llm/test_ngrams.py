import math
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithoscope.llm import ngrams, queries
from lithoscope.llm.common import fold, table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), None]


@cache
def level(count):
    return max(j for j in range(1, 100) if math.ceil(1.5 ** (j - 1)) <= count)


@cache
def mean(level):
    own = [c for c in range(1, 10_000) if math.ceil(1.5 ** (level - 1)) <= c < math.ceil(1.5**level)]
    return (own[0] + own[-1]) / 2


def brute(docs, order, weight, read=None):
    """n_tokens, n_known, N, base and score by row of (doc_id, text), from dictionaries; ``read`` stands for the filter."""
    learned = [words(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for own in learned for w in own)
    marked = lambda own, at, k: tuple(own[j] if j >= 0 else "BEGIN " for j in range(at - k + 1, at + 1))
    seen = Counter(marked(own, at, k) for own in learned for at in range(len(own)) for k in range(2, order + 1))
    read = read or (lambda g: mean(level(seen[g])) if seen[g] else 0)
    n, v, out = sum(counts.values()), len(counts), []
    for _, text in docs:
        own, base, score, before = words(text), 0.0, 0.0, {}
        for at, w in enumerate(own):
            p = b = (counts[w] + 0.1) / (n + 0.1 * (v + 1))
            shorter, now = counts[w], {2: counts[w]}
            for k in range(2, order + 1):
                context = before.get(k, 0) if at else counts[None]
                count = min(read(marked(own, at, k)), shorter, context)
                p = (count + weight * p) / (context + weight)
                shorter = now[k + 1] = count
            before, base, score = now, base + math.log10(b), score + math.log10(p)
        out.append((len(own), sum(counts[w] > 0 for w in own), n, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_brute_force(spark, order):
    """With the same filter, read event by event by a set of its bits; and near the model whose counts are not filtered."""
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = ngrams.fit(df, fold("doc_id", 10) != 0, order=order)
    bits = {r.block: {(k, b) for k, x in enumerate(np.frombuffer(r.bits, np.uint64).tolist()) for b in range(64) if x >> b & 1} for r in model.blocks.collect()}
    sizes = {r.block: len(r.bits) // 8 for r in model.blocks.collect()}
    codes = {w: ngrams.tokens(pa.array([w]))[1][0] for w in {w for _, t in docs for w in words(t)} - {None}} | {None: ngrams.END, "BEGIN ": ngrams.BEGIN}

    @cache
    def read(gram):
        with np.errstate(over="ignore"):
            h = np.full(1, np.uint64(len(gram)))
            for w in gram:
                h = ngrams.mixed(h * ngrams._K + codes[w])
        h, j = int(h[0]), 0
        block = (h >> 32) * model.n_blocks >> 32
        while block in sizes:
            e = int(ngrams.mixed(np.array([(h % (1 << 32) + (j + 1) * int(ngrams._K)) % (1 << 64)], np.uint64))[0])
            at = (e >> 32) * sizes[block] >> 32
            if not all((at, e >> s & 63) in bits[block] for s in (0, 6, 12, 18)):
                break
            j += 1
        return mean(j) if j else 0

    got = {r.id: r for r in ngrams.score(df, model).collect()}
    for (i, _), same, exact in zip(docs, brute(docs, order, ngrams.WEIGHT, read), brute(docs, order, ngrams.WEIGHT)):
        assert (got[i].n_tokens, got[i].n_known, model.n_tokens) == same[:3]
        assert got[i].base_score == pytest.approx(same[3], rel=1e-12) and got[i].score == pytest.approx(same[4], rel=1e-9)
        assert got[i].score == pytest.approx(exact[4], rel=0.02)
    # a filter that is not broadcast gives the same scores
    routed = {r.id: tuple(r) for r in ngrams.score(df, model, most_bytes=0).collect()}
    assert routed == {i: tuple(r) for i, r in got.items()}
    model.scratch.clear()


def test_filter_is_never_low_and_rarely_high():
    rng = np.random.default_rng(5)
    hashes = np.unique(rng.integers(0, 1 << 63, 200_000).astype(np.uint64) * np.uint64(2))
    counts = np.minimum(rng.zipf(1.6, len(hashes)), 10**9)
    assert [int(x) for x in ngrams.levels_of(np.array([1, 2, 3, 4, 5, 6, 7, 8]))] == [level(c) for c in range(1, 9)]
    known, n_blocks = slice(0, 150_000), 7
    block = ngrams.blocks_of(hashes[known], n_blocks)
    bits = [ngrams.made_filter(ngrams.rests(hashes[known][block == k]), counts[known][block == k]) for k in range(n_blocks)]
    found = ngrams.Filter(list(range(n_blocks)), bits, [], [], n_blocks).levels(ngrams.placed(hashes, n_blocks))
    true = ngrams.levels_of(counts[known])
    assert (found[known] >= true).all() and (found[known] > true).mean() < 0.02 and (found[150_000:] > 0).mean() < 0.02


def test_keys_are_squeezed():
    rng = np.random.default_rng(6)
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 5000):
            keys = np.sort(rng.integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True))
            assert (ngrams.spread(ngrams.squeezed(keys), kind) == keys).all()
            assert n < 100 or len(ngrams.squeezed(keys)) < 0.9 * keys.nbytes


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_score(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = dict(zip([i for i, _ in docs], brute(docs, 2, ngrams.WEIGHT)))
    for r in got:
        n, known, train, base, score = want.pop(r.doc_id)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=0.02)
    assert not want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_edges(spark, most_bytes):
    rows = [(1, "A b c", "x"), (1, "A b c", "x"), (2, None, "x"), (3, "", "x"), (4, " \n\t", "x"), (None, "a b", "x"), (5, "wört " * 30_000, "x"), (6, "w" * 200_000, "x"), (7, "b c zzz", "x")]
    df = spark.createDataFrame(rows, "`doc.id` long, text string, id string")
    model = ngrams.fit(df, F.col("`doc.id`") != 7)
    got = sorted(((r.id, r.n_tokens, r.n_known) for r in ngrams.score(df, model, "doc.id", most_bytes=most_bytes).collect()), key=str)
    assert got == sorted([(1, 4, 4), (1, 4, 4), (2, 1, 1), (3, 1, 1), (4, 1, 1), (None, 3, 3), (5, 30_001, 30_001), (6, 2, 2), (7, 4, 3)], key=str)
    assert model.n_tokens == 4 + 4 + 1 + 1 + 1 + 30_001 + 2 and model.n_words == 6
    nothing = ngrams.fit(df, F.lit(None).cast("boolean"))
    assert [(r.n_known, r.base_score, r.score) for r in ngrams.score(df.where("`doc.id` = 7"), nothing, "doc.id", most_bytes=most_bytes).collect()] == [(0, 0.0, 0.0)]
    assert ngrams.score(df.limit(0), model, "doc.id", most_bytes=most_bytes).count() == 0
