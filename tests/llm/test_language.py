import math
import re

import numpy as np
import pyarrow as pa

from lithoscope.llm import language, queries
from lithoscope.llm.common import fold, table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents")
    got = queries.op9_language(spark, sf)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got.count() == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98


def test_gradients_and_reading():
    net, rng = language.Reader(["a", "b", "c"], 4), np.random.default_rng(0)
    codes, target = rng.integers(97, 120, (5, 7)), np.array([0, 1, 2, 0, 1, 2, 0])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    grads = net.gradients(codes, target)

    def log_probabilities():
        return net._output(net._run(codes, "f")[0], net._run(codes[::-1], "b")[0])

    assert np.allclose(net.read(codes), log_probabilities().sum(axis=0), atol=1e-4)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        value, loss = net.weights[name][at], []
        for e in (1e-3, -1e-3):
            net.weights[name][at] = value + e
            loss.append(-log_probabilities()[:, np.arange(7), target].mean())
        net.weights[name][at] = value
        assert abs((loss[0] - loss[1]) / 2e-3 - g[at]) < 1e-4


def test_edges(spark):
    en, de = "the that with and reading ", "der die und schön ßtück "
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "12 !! …", None, "x"), (None, en, "en", "x"), (1, en * 3, "en", "x"), (103, de * 30_000, None, "x"), (104, "ß" * 500, "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = language.predict(docs, language.fit(docs, fold("doc_id", 3) != 1)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(60)) and by[103].lang_pred == "de" and by[104].lang_pred == "de"
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.limit(0), fold("doc_id", 3) != 1)).collect()} == {"und"}
    assert language.predict(docs.limit(0), language.fit(docs, fold("doc_id", 3) != 1)).count() == 0


def test_sliced_batches():
    texts = pa.array(["x", "Ünï one", None, "TWO"]).slice(1, 3)
    bounds, words = language.normal_windows(texts)
    assert [words.to_pylist()[a:b] for a, b in zip(bounds, bounds[1:])] == [["Ünï", "one"], [""], ["two"]] or bounds.tolist() == [0, 2, 3, 4]


def test_documents_are_brute_force():
    """The network once more, position by position in plain Python, and documents' probabilities from its outputs."""
    net = language.Reader(["aa", "bb", "cc"], 3, seed=5)
    w, h = {k: v.astype(float) for k, v in net.weights.items()}, 3
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(piece, way):
        out, state = [], [0.0] * h
        for byte in piece:
            x = [a + b for a, b in zip(w["x" + way][byte], w["c" + way])]
            u = [sum(state[i] * w["u" + way][i][j] for i in range(h)) for j in range(3 * h)]
            r, z = ([sigmoid(x[k * h + i] + u[k * h + i]) for i in range(h)] for k in (0, 1))
            new = [math.tanh(x[2 * h + i] + r[i] * u[2 * h + i]) for i in range(h)]
            state = [z[i] * state[i] + (1 - z[i]) * new[i] for i in range(h)]
            out.append(state)
        return out

    def answer(text):
        total, positions = [0.0] * 3, 0
        for window in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
            for piece in language.pieces(window):
                forward, backward = states(piece, "f"), states(piece[::-1], "b")[::-1]
                for one, other in zip(forward, backward):
                    logit = [sum(v * w["o"][i][k] for i, v in enumerate([*one, *other])) + w["b"][k] for k in range(3)]
                    norm = math.log(sum(map(math.exp, logit)))
                    total = [t + x - norm for t, x in zip(total, logit)]
                positions += len(piece)
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        p = [math.exp(t / positions) for t in total]
        return ["aa", "bb", "cc"][p.index(max(p))], max(p) / sum(p)

    texts = ["One two, THREE", "sch\u00f6n " * 3, "\u65e5\u672c\u8a9e" * 30, "a" * 63 + "\u00df" * 40, None, "12 \u2026", "x"]
    langs, scores = language.Memory(net).documents(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores):
        want = answer(text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def test_pieces_are_whole_characters():
    for text in ("a" * 200, "\u00df" * 100, "x" + "\u65e5" * 90, "\U0001f600" * 40):
        cut = language.pieces(text.encode())
        assert b"".join(cut) == text.encode() and all(len(p) <= language.LONGEST and p.decode() for p in cut)
