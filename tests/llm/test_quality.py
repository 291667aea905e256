import numpy as np

from lithoscope.llm import quality, queries
from lithoscope.llm.common import fold, table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op4_quality(spark, sf)
    labelled = got.where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    assert got.count() == table(spark, sf, "documents").count()
    assert np.mean([r.predicted == r.quality for r in labelled]) >= 0.98
    good, bad = ([r.score for r in labelled if r.quality == q] for q in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.98


def test_edges(spark):
    words = "Some plain words, written in a calm order. "
    rows = [(i, words * (i % 3 + 1) if i % 2 else "BAD!! SHOUT!! | |" * (i % 3 + 1), "x") for i in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (102, " \n", "x"), (None, words, "x"), (1, rows[1][1], "x"), (103, words * 20_000, "x"), (104, "ß" * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100, None), (101, 7), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels, fold("doc_id", 5) != 0)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[100] == by[101] == by[102] and by[103] > 0.9 and by[None] > 0.9 and by[2] < 0.1
    assert {r.score for r in got if r.doc_id == 1} == {by[1]}
    unlearned = quality.score(docs, quality.fit(docs, labels.limit(0), fold("doc_id", 5) != 0)).collect()
    assert {r.score for r in unlearned} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs, labels, fold("doc_id", 5) != 0)).count() == 0


def test_votes_are_brute_force():
    """Every cosine and vote again, one at a time, from the counts."""
    rng = np.random.default_rng(4)
    parts = ["Plain words", "12 apples;", "SHOUT!!", "a b c", "| |", "x9x9", "end.", "\u00fcber", "\u65e5\u672c", "again again"]
    texts = [" ".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(90)]
    labels = [int(x) for x in rng.integers(0, 2, 60)]
    voters = quality.Voters(quality.counts(texts[:60]), labels, dims=8, neighbours=7)
    got = voters.score([*texts[60:], None, ""])

    def latent(text):
        weighted = quality.counts([text])[0].astype(float) * voters.idf
        weighted /= max(np.sqrt((weighted**2).sum()), 1e-12)
        placed = np.array([sum(w * a for w, a in zip(weighted, axis)) for axis in voters.axes.T.astype(float)])
        return placed / max(np.sqrt((placed**2).sum()), 1e-12)

    space = [latent(t) for t in texts[:60]]
    for text, score in zip([*texts[60:], None, ""], got):
        own = latent(text)
        votes = sorted(((sum(a * b for a, b in zip(own, other)), label) for other, label in zip(space, labels)), reverse=True)
        # equal cosines may stand on both sides of the last place, so any choice among them is right
        last = votes[6][0]
        sure, open_ = [v for v in votes if v[0] > last + 1e-4], [v for v in votes if abs(v[0] - last) <= 1e-4]
        share = lambda chosen: sum(max(c, 0) ** 8 * label for c, label in chosen) / max(sum(max(c, 0) ** 8 for c, _ in chosen), 1e-300)
        some = [share([*sure, *sorted(open_, key=lambda v: v[1], reverse=up)[: 7 - len(sure)]]) for up in (False, True)]
        if not any(own):
            assert abs(score - np.mean(labels)) < 1e-6
        else:
            assert min(some) - 1e-3 <= score <= max(some) + 1e-3


def test_other_scripts_count():
    found = quality.counts(["\u65e5\u672c\u8a9e \u3067\u3059", "\u00fcber", "uber", ""])
    assert found[0].any() and (found[1] == found[2]).all() and not found[3].any()


def test_the_space_is_worked_out_in_a_task(spark, monkeypatch):
    """What the driver gets is what it sends to the tasks; decompositions take more memory than it has."""

    def refused(*_):
        raise AssertionError("in the driver")

    docs = spark.createDataFrame([(i, "Plain words, here. " * (i % 3 + 1) if i % 2 else "BAD!! | |" * (i % 3 + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(np.linalg, "eigh", refused)
    voters = quality.fit(docs, labels, fold("doc_id", 5) != 0)
    assert voters.vectors.shape == (len(voters.labels), quality.DIMS) and 0 < voters.labels.sum() < len(voters.labels)
