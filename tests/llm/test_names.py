"""Every operator over tables whose further columns have names that need quoting, and under a size with a unit in the session."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lithoscope.llm import decontaminate, jaccard, language, merkle, ngrams, packing, quality, substring, suffixes, token_store
from lithoscope.llm.common import fold, table
from lithoscope.llm.encoding import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["a b", "a.b", "tick`s", "SCORE ", "s"]
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture()
def docs(spark):
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, "64m")
    odd = [F.lit(k).alias(n) for k, n in enumerate(ODD[:-1])]
    yield table(spark, SF, "documents").limit(80).select("*", *odd, F.struct(F.lit(1).alias("a b"), F.lit(2).alias("x`.y")).alias("s"))
    spark.conf.set(SETTING, before)


def test_operators(spark, docs):
    labels, benchmark, n = table(spark, SF, "labels"), table(spark, SF, "benchmark"), docs.count()
    made = {
        "quality": quality.score(docs, quality.fit(docs, labels, fold("doc_id", 5) != 0)),
        "language": language.predict(docs, language.fit(docs, fold("doc_id", 3) != 1, per_language=2)),
        "substring": substring.remove_repeats(docs),
        "suffixes": suffixes.remove_repeats(docs),
        "marks": decontaminate.mark(docs, benchmark),
    }
    for name, df in made.items():
        assert set(ODD) <= set(df.columns), name
        rows = df.select(F.col("`tick``s`").alias("t"), F.col("s.`x``.y`").alias("y")).collect()
        assert len(rows) == n and {(r.t, r.y) for r in rows} == {(2, 2)}, name
    assert jaccard.keep_one(docs, 5, 80).columns == docs.columns
    assert decontaminate.remove_contaminated(docs, benchmark).columns == docs.columns
    pieces = packing.cut_documents(docs, tokenizer_path()).withColumn("a.b", F.lit(1))
    assert "a.b" in packing.pack(pieces).columns and packing.pack(pieces).count() == pieces.count()
    assert token_store.encode_to_store(docs, tokenizer_path()).count() == n
    assert ngrams.score(docs, ngrams.fit(docs, F.lit(True))).count() == n
    assert merkle.manifest(docs, ["doc_id", "a.b", "tick`s"], group="a b", order="doc_id").select("root").distinct().count() == 1


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0


def test_a_place_in_a_sequence_does_not_hang_on_chance(spark):
    rows = [(1, 0, n, n, 9) for n in (5, 7, 5, 9, 2048, 7)] * 3
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    one, two = (sorted(map(tuple, packing.pack(pieces.repartition(k)).collect())) for k in (1, 5))
    assert one == two
