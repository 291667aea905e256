import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lithoscope.llm import encoding, token_store
from lithoscope.llm.common import staging_path, table
from lithoscope.llm.encoding import WordEncoder, tokenizer_path

SCHEMA = "doc_id long, text string, start string"


def expected(rows):
    tok, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows)):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_hold_every_id(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "a  b\n\nÉÉ.. don't's <|endoftext|>x"), (10_003, rows[0][1] * 9)]
    docs = spark.createDataFrame([(a, b, "clash") for a, b in rows], SCHEMA)
    path = staging_path(spark, "test-store")
    token_store.write_store(docs, path, tokenizer_path())
    got = token_store.read_summary(spark, path).collect()
    assert all(r.verified for r in got)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected(rows)
    whole = token_store.read_ids(spark, path).collect()
    assert sorted((r.doc_id, r.start, len(r.ids) // r.width, zlib.crc32(np.frombuffer(r.ids, f"<u{r.width}").astype("<u4").tobytes())) for r in whole) == expected(rows)
    stored = spark.read.parquet(f"{path}/chunks")
    assert stored.count() == stored.select("digest").distinct().count()


def test_repeated_rows_and_empty_table(spark):
    got = token_store.encode_to_store(spark.createDataFrame([(1, "same"), (1, "same"), (None, "x")], "doc_id long, text string"), tokenizer_path()).collect()
    assert len(got) == 3 and sorted(r.start for r in got) == [0, 2, 4]
    assert token_store.encode_to_store(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_any_flipped_byte_is_told(spark, monkeypatch):
    monkeypatch.setattr(token_store, "LEVEL", 2)
    texts = [(k, f"document {k} " + " ".join(f"w{k}x{i}" for i in range(400 * k))) for k in range(12)]
    path = staging_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame(texts, "doc_id long, text string").coalesce(2), path, tokenizer_path())
    changes = {
        "chunks": ("payload", "concat(payload, x'00')"),
        "recipes": ("n_tokens", "if(doc_id = 3, n_tokens + 1, n_tokens)"),
        "manifest": ("root", "unhex(sha2(root, 256))"),
    }
    unchanged = token_store.read_summary(spark, path).collect()
    assert len(unchanged) == 12 and all(r.verified for r in unchanged)
    for name in ("chunks", "recipes", "manifest"):
        other = staging_path(spark, "test-store")
        for part in ("chunks", "recipes", "manifest"):
            rows = spark.read.parquet(f"{path}/{part}")
            rows = rows.withColumn(changes[part][0], F.expr(changes[part][1])) if part == name else rows
            rows.write.parquet(f"{other}/{part}")
        assert not all(r.verified for r in token_store.read_summary(spark, other).collect())
    lost = staging_path(spark, "test-store")
    for part in ("chunks", "recipes", "manifest"):
        rows = spark.read.parquet(f"{path}/{part}")
        (rows.where("doc_id <> 3") if part == "recipes" else rows).write.parquet(f"{lost}/{part}")
    assert not all(r.verified for r in token_store.read_summary(spark, lost).collect())


def test_letters_that_change_length():
    """Capital letters whose lower case is longer, and marks that compose with what stands before them, against the tokenizer itself."""
    rng, encoder = random.Random(3), WordEncoder(tokenizer_path())
    longer = [chr(c) for c in range(0x80, 0x1F000) if len(chr(c).lower()) > 1]
    pieces = ["a", "B", "don't", "'s", "'", "'RE", "H\u0331", "\u0130", "i\u0307", "=\u0338", "<\u0338", "|", "<|endoftext|>", "<|STARTOFTEXT|>", "\u2026", "\u00a0", "\u2003", "\r", "\t", "\n", " ", "1", "\u00bd"]
    pieces += [",", ".", "!?", "e\u0301", "\u1e9e", "\u0391\u03a3", "\u65e5\u672c", "\U0001f600", "\u200b", "\0", "\x85", "\u0345", "\ufb01", *longer]
    texts = ["YEN\u0130 M\u00dc\u015eTER\u0130, SAH\u0130B\u0130."]
    texts += ["".join(rng.choice(pieces) if rng.random() < 0.8 else chr(rng.randrange(0x80, 0x3000)) for _ in range(rng.randrange(1, 12))) for _ in range(30_000)]
    for at in range(0, len(texts), 1000):
        ids, bounds = encoder.encode(pa.array(texts[at : at + 1000]))
        for k, text in enumerate(texts[at : at + 1000]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_two_units_with_one_key(monkeypatch):
    real = encoding.stretch_hashes

    def few(plain, starts, tables):
        (keys, checks), sizes = real(plain, starts, tables)
        return [keys % np.uint64(7), checks], sizes

    encoder, texts = WordEncoder(tokenizer_path()), ["one two three", "four five six seven eight", "nine ten one"]
    want = [i for t in texts for i in [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]]
    monkeypatch.setattr(encoding, "stretch_hashes", few)
    for _ in range(2):
        assert encoder.encode(pa.array(texts))[0].tolist() == want
