import hashlib
import re

from lithoscope.llm import decontaminate, queries
from lithoscope.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, size=10):
    wins = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if got := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= got
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    bench = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert sorted(map(tuple, queries.op8_decontaminate(spark, sf).collect())) == brute(docs, bench)


def test_edges_blocks_and_offsets(spark):
    text = "Ünï one, TWO three\nfour five six seven eight nine ten eleven! end"
    docs = spark.createDataFrame([(1, text, 7), (2, None, 7), (3, "", 7), (1, text, 7), (None, "short itém", 7), (4, "...", 7)], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Short iTÉm"), (3, "short itém"), (4, None), (5, ""), (6, "?")], "item_id long, text string")
    for most in (1 << 20, 60):
        got = decontaminate.mark(docs, bench, most_bytes=most).select("doc_id", "text", "n_words", "spans", "items").collect()
        by = {r.doc_id: r for r in got}
        assert len(got) == 6
        (span,) = by[1].spans
        assert text[span.begin : span.end] == "one, TWO three\nfour five six seven eight nine ten eleven" and by[1]["items"] == ["1"]
        assert by[None]["items"] == ["3"] and by[2].n_words == 0 and by[4].spans == []
    assert decontaminate.remove_contaminated(docs, bench).count() == 3
    assert decontaminate.mark(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.mark(docs.limit(0), bench).count() == 0


def test_items_without_id_hit(spark):
    docs = spark.createDataFrame([(1, "so: short item here"), (2, "another text"), (3, "long one")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "Short item"), (5, "long one"), (None, "long one")], "item_id long, text string")
    for most in (1 << 20, 10):
        by = {r.doc_id: r for r in decontaminate.mark(docs, bench, most_bytes=most).collect()}
        assert [(s.first_word, s.last_word) for s in by[1].spans] == [(1, 2)] and by[1]["items"] == []
        assert by[2].spans == [] and by[3]["items"] == ["5"] and len(by[3].spans) == 1
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()] == [2]
