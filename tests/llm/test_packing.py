import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lithoscope.llm import packing, queries
from lithoscope.llm.common import staging_path, table
from lithoscope.llm.encoding import tokenizer_path


def padding(rows):
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill.values()) / sum(fill.values())


def check(rows, texts):
    tok, by, seq = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert by.keys() == texts.keys()
    for doc_id, own in by.items():
        ids, at = np.array([*tok.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_pack(spark, sf).collect()
    check(rows, {r.doc_id: r.text for r in table(spark, sf, "documents").collect()})
    assert padding(rows) < 0.02


def test_edges_and_files(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a b c", None: "x", 5: "w " * 2047}
    docs = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "doc_id long, text string, length string")
    check(packing.pack_documents(docs, tokenizer_path()).collect(), texts)
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0
    twice = packing.pack_documents(docs.union(docs), tokenizer_path()).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    files = packing.write_sequences(docs, staging_path(spark, "seq"), tokenizer_path(), pad=9).collect()
    tokens = sum(r.doc_tokens for r in packing.pack_documents(docs, tokenizer_path()).where("start = 0").collect())
    assert sum(sum(r.lengths) for r in files) == tokens and all(len(r.ids) // 4 == (sum(r.lengths) if sum(r.lengths).bit_count() == 1 else 2048) for r in files)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_every_piece_is_placed(demand):
    placed = defaultdict(int)
    for times, filling in packing.solve(demand, 64):
        assert times > 0 and sum(c * k for c, k in filling.items()) <= 64
        for c, k in filling.items():
            placed[c] += times * k
    assert placed == demand


def test_few_sequences():
    rng = np.random.default_rng(0)
    demand = {int(c): int(n) for c, n in zip(range(1, 129), rng.integers(500, 1500, 128))}
    used = sum(times for times, _ in packing.solve(demand))
    assert used <= 1.02 * sum(c * n for c, n in demand.items()) / 128


def test_columns_named_like_internal_ones_stay(spark):
    rows = [(k, 0, 100 + k, k, f"b{k}", -k, "old") for k in range(30)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, _rank long, _bucket string, _class int, sequence_id string")
    got = packing.pack(pieces)
    assert got.columns == ["doc_id", "start", "length", "_rank", "_bucket", "_class", "sequence_id", "offset"]
    assert sorted((r.doc_id, r._rank, r._bucket, r._class) for r in got.collect()) == [(k, k, f"b{k}", -k) for k in range(30)]
