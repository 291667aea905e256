import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from lithoscope.llm import anchors, queries, suffixes
from lithoscope.llm.common import table


def brute(docs, size=200):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(hash(b[i : i + size]) for _, b in raw for i in range(len(b) - size + 1))
    out = []
    for d, b in raw:
        change = np.zeros(len(b) + 1, int)
        for i in range(len(b) - size + 1):
            if seen[hash(b[i : i + size])] > 1:
                change[i] += 1
                change[i + size] -= 1
        gone = np.cumsum(change)[:-1] > 0
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, queries.op3_suffixes(spark, sf).collect()), key=str) == brute(docs)


@pytest.mark.parametrize("most", [2048, 2])
def test_edges(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(anchors, "MOST_CONTEXTS", most)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    line = noise(400)
    docs = [(i, noise(rng.randrange(300)) + line[rng.randrange(150) : rng.choice([200, 300, 350, 400])] + noise(rng.randrange(300))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "ab" * 99), (103, "ab" * 100 + "a"), (104, "xyz" * 3000), (105, noise(100) * 4), (5, docs[5][1]), (5, docs[6][1]), (None, docs[3][1]), (107, "ß" + docs[0][1])]
    spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, kept string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op3_suffixes(spark, str(tmp_path)).collect()), key=str) == brute(docs)
    assert suffixes.remove_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0


def test_merge_is_a_sort(monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 700)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 4, 300).astype(np.uint8).tobytes()
    rows = [{"anchor": 1, "context": k, "n": 1, "windows": 101, "payload": base[:k] + rng.integers(0, 4, 300 - k).astype(np.uint8).tobytes()} for k in (0, 120, 240, 299, 260, 300, 300)]
    seen = Counter(r["payload"][i : i + 200] for r in rows for i in range(101))
    want = {k: [seen[r["payload"][i : i + 200]] > 1 for i in range(101)] for k, r in enumerate(rows)}
    got = {id_: np.unpackbits(np.frombuffer(mask, np.uint8), count=101).astype(bool).tolist() for id_, (_, _, mask) in zip([k for k in want if any(want[k])], suffixes.block_masks(rows))}
    assert got == {k: v for k, v in want.items() if any(v)}


def test_clashing_names_and_a_long_text_of_one_letter(spark):
    docs = spark.createDataFrame([(1, "z" * 2_000_000, 7, "a", 1.5), (2, "y" * 250, 8, "b", 2.5), (3, "ab" * 101, 9, "c", 3.5)], "doc_id long, text string, _row int, _spans string, _OWN double")
    began = time.time()
    got = suffixes.remove_repeats(docs)
    rows = sorted(got.select("doc_id", "n_removed", "_row", "_spans", "_OWN").collect())
    assert list(map(tuple, rows)) == [(1, 2_000_000, 7, "a", 1.5), (2, 250, 8, "b", 2.5), (3, 202, 9, "c", 3.5)] and time.time() - began < 40
