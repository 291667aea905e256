import numpy as np

from lithoscope.llm import ann, queries
from lithoscope.llm.common import table


def brute(rows, k=20):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = np.cumsum(v * v[q], axis=1)[:, -1]
        order = np.lexsort((ids, -score))
        out[int(ids[q])] = [(int(ids[i]), score[i]) for i in order if ids[i] != ids[q]][:k]
    return out


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    want = brute([(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()])
    got = {}
    for r in queries.op10_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    recall = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.99
    exact = [dict(want[q])[a] == s for q in want for a, s in got[q] if a in dict(want[q])]
    assert all(exact)


def test_ties_blocks_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)] + [(i, [1.0] * 8) for i in range(200, 300)]
    bad = [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (480, [float("inf")] * 8), (500, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows + bad], "id long, v array<double>, score string").repartition(5)
    asked = df.where("id % 20 = 0")
    for size in (32_768, 16):
        got = {}
        for r in ann.search(df, asked, block_rows=size, query_rows=6).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == brute(rows)
    assert ann.search(df.limit(0), asked).count() == 0 and ann.search(df, asked.limit(0)).count() == 0
    assert ann.search(df.where("id < 3 or id = 20"), df.where("id = 20")).count() == 3
