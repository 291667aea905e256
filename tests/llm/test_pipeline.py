import corpus_pipeline
from lithoscope.llm.common import staged, table
from test_decontaminate import brute as hits
from test_jaccard import brute as families
from test_packing import check, padding
from test_substring import brute as repeats

SF = "/root/testdata/sf0.01"


def test_stages_are_brute_force(spark):
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "substring", "decontamination", "packing"]
    before, kept = {r.doc_id: r.text for r in docs.collect()}, {}
    for name in list(stages)[:-1]:
        docs = staged(stages[name](spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert all(labels.get(d, 1) == 1 for d in kept["quality"]) and all(d in kept["quality"] for d in before if labels.get(d) == 1)
    assert sorted(kept["near_duplicates"]) == sorted(d for d, _, c in families(sorted(kept["quality"].items()), 5, 80) if d == c)
    removed = {d: n for d, _, n, _ in repeats(sorted(kept["near_duplicates"].items()))}
    assert kept["substring"].keys() == removed.keys() and any(removed.values())
    assert all((t != kept["near_duplicates"][d]) == (removed[d] > 0) for d, t in kept["substring"].items())
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(kept["decontamination"]) == [d for d, *_, bad in hits(sorted(kept["substring"].items()), bench) if not bad]
    rows = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    check(rows, kept["decontamination"])
    assert padding(rows) < 0.03


def test_edges(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents").limit(50)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, None, None)], docs.schema)
    docs.union(odd).union(odd).withColumn("label", F.lit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
