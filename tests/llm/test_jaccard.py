import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lithoscope.llm import jaccard, queries, words
from lithoscope.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size, percent):
    sets = [(d, shingles(t, size)) for d, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    pairs = {(a, b) for own in at.values() if len(own) < 400 for a in own for b in own if a < b}
    for a, b in pairs:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(sets):
        least[find(k)] = min(d, least.get(find(k), d))
    return sorted((d, len(s), least[find(k)]) for k, (d, s) in enumerate(sets))


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, queries.op5_jaccard(spark, sf).collect())) == brute(docs, 3, 90)


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3), (1, 40, 4)])
def test_planted_families(spark, size, percent, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng, docs = random.Random(seed), []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 40, 150]))]
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(int(len(own) * rng.choice([0, 0.01, 0.03, 0.06]))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b"), (906, "A\tb")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n int").repartition(3)
    got = sorted(map(tuple, jaccard.near_duplicates(df, size, percent).select("doc_id", "n_shingles", "component_id").collect()))
    want = brute(docs, size, percent)
    assert got == want
    kept = jaccard.keep_one(df, size, percent)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in want if d == c)


def test_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "z " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, jaccard.near_duplicates(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect()))
    assert len(got) == 5 and sum("component_id=1)" in x for x in got) == 3
    assert jaccard.near_duplicates(df.limit(0), 3, 90).count() == 0


def test_a_class_without_doc_id_joins_two_others(spark):
    chain = [(k, " ".join(f"w{i}" for i in range(k - 1, k + 19))) for k in (1, 2, 3)]  # neighbours 19 of 21, ends 18 of 22
    df = spark.createDataFrame([(None if k == 2 else k, text) for k, text in chain], "doc_id long, text string")
    got = jaccard.near_duplicates(df, 1, 85).select("doc_id", "component_id").collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={d}, component_id=1)" for d in (1, None, 3))
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(df, 1, 85).collect()) == ["1", "None"]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:280], rng.integers(0, 1 << 63, 15).astype(np.uint64)]))
    for n in (5, 40):
        x, y = jaccard.sketch(a, n), jaccard.sketch(b, n)
        assert np.bitwise_count(x[0] ^ y[0]).sum() <= len(np.setxor1d(a, b))
        assert ((x[1] != y[1]) >= (x[0].view(np.uint8)[:n] != y[0].view(np.uint8)[:n])).all()


def test_words_of_sliced_batches():
    texts = pa.array(["skip", "A b\tC", None, " é  x\n"]).slice(1)
    bounds, hashes = words.word_hashes(texts, words.BLANKS_LOWER)
    assert bounds.tolist() == [0, 3, 3, 5] and len(set(hashes.tolist())) == 5


@pytest.mark.parametrize("percent", [40, 50, 60, 66, 80, 90])
def test_no_sizes_are_too_far_apart(spark, percent):
    """A set and parts of it, from the smallest that links with it on: their sizes differ by as much as the threshold allows."""
    docs = []
    for n in (3, 20, 100, 150):
        base = [f"{n}w{k}" for k in range(n)]
        least = -(-n * percent // 100)
        for size in {least - 1, least, least + 1, (least + n) // 2, n}:
            docs.append((len(docs), " ".join(base[:size])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(df, 1, percent).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(docs, 1, percent)


def test_groups_are_settled_with_their_sets(spark, monkeypatch):
    """Without any search by sketch before: chains and stars just above and below the threshold, in blocks of a few rows."""
    monkeypatch.setattr(jaccard, "FORESTS", ())
    monkeypatch.setattr(jaccard, "SET_BYTES", 1 << 14)
    rng, docs = random.Random(9), []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(60)]
        for _ in range(12):
            own = list(base)
            for k in rng.sample(range(60), rng.choice([3, 6, 8, 9, 12])):
                own[k] = f"x{rng.randrange(40)}"
            docs.append((len(docs), " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(df, 1, 75).select("doc_id", "n_shingles", "component_id").collect()))
    want = brute(docs, 1, 75)
    assert got == want and 6 < len({c for _, _, c in want}) < len(docs)


def test_near_copies_are_settled_in_one_pool(spark, monkeypatch):
    """Near copies that meet in many groups come to the last step with their sets once or so, not once for each group."""
    monkeypatch.setattr(jaccard, "FORESTS", ())
    settle, seen = jaccard.settled_links, []
    monkeypatch.setattr(jaccard, "settled_links", lambda members, percent: seen.append(members.count()) or settle(members, percent))
    rng, docs = random.Random(5), []
    base = [f"w{k}" for k in range(120)]
    for _ in range(60):
        own = list(base)
        for k in rng.sample(range(120), 15):
            own[k] = f"x{rng.randrange(10**6)}"
        docs.append((len(docs), " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(df, 1, 80).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(docs, 1, 80) and 0 < seen[0] <= 3 * len(docs)


def test_pools_take_no_more_rows_than_their_groups(spark):
    from pyspark.sql import functions as F

    from lithoscope.llm.common import Scratch

    family = [(key, 2, f"f{m}") for key in range(30) for m in range(12) if (key + m) % 5]
    chain = [(100 + key, 2, f"c{key + m:03}") for key in range(200) for m in range(2)]
    searched = spark.createDataFrame(family + chain, "key long, band int, fp string").withColumn("fp", F.encode("fp", "utf-8"))
    rows = [(r.key, bytes(r.fp).decode()) for r in jaccard.pooled(searched, F.lit(16), Scratch(spark, "pools")).collect()]
    assert sorted(fp for key, fp in rows if fp[0] == "f") == sorted(f"f{m}" for m in range(12)) and len({key for key, fp in rows if fp[0] == "f"}) == 1
    assert sorted(row for row in rows if row[1][0] == "c") == sorted((key, fp) for key, _, fp in chain)
