import hashlib
import random
import re

import pytest

from lithoscope.llm import anchors, queries, substring
from lithoscope.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, size=13):
    first, cut = {}, [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in cut:
        for i in range(len(w) - size + 1 if d is not None else 0):
            key = tuple(w[i : i + size])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - size + 1 if d is not None else 0):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, queries.op6_substring(spark, sf).collect()), key=str) == brute(docs)


@pytest.mark.parametrize("most", [2048, 2])
def test_edges(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(anchors, "MOST_CONTEXTS", most)
    rng = random.Random(5)
    line = [f"l{i}" for i in range(18)]
    docs = [(i, " ".join([f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30))] + line[: rng.choice([12, 13, 14, 18])] + [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30))])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, " \t"), (103, "a a " * 40), (104, "a a " * 9000), (105, "é x " * 30), (5, docs[5][1]), (5, "other " * 30), (106, "other " * 20), (None, docs[3][1]), (107, docs[0][1].replace(" ", "\n\n"))]
    spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_words string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op6_substring(spark, str(tmp_path)).collect()), key=str) == brute(docs)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert left[102].text == " \t" and left[100].text is None and left[107].spans and left[107].n_removed == sum(s.last - s.first + 1 for s in left[107].spans)
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(200):
        shard = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(3)]
        asked = [rng.randrange(4) for _ in range(15)]
        automaton = substring.SuffixAutomaton()
        for s in shard:
            automaton.add(s)
        held = {tuple(s[i:j]) for s in shard for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max([n for n in range(e + 2) if n == 0 or tuple(asked[e + 1 - n : e + 1]) in held]) for e in range(len(asked))]
        assert automaton.statistics(asked) == want


def test_clashing_names(spark):
    line = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, line, 7, "a", 0.5), (2, f"x {line} y", 8, "b", 1.5), (None, line, 9, "c", 2.5)], "doc_id long, text string, _row int, _spans string, _OTHER double")
    got = sorted(map(str, substring.remove_repeats(docs).select("doc_id", "text", "_row", "_spans", "_OTHER", "n_removed").collect()))
    assert got == sorted(map(str, docs.selectExpr("doc_id", "if(doc_id = 2, 'x y', text) as text", "_row", "_spans", "_OTHER", "if(doc_id = 2, 20, 0) as n_removed").collect()))
