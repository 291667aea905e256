import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lithoscope.llm import merkle, queries
from lithoscope.llm.common import table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes):
    """The tree's root, and for each leaf its siblings before and after it by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for p, i in zip(paths, at):
            p.append(("".join(runs[i // 8][: i % 8]), "".join(runs[i // 8][i % 8 + 1 :])))
        at, level = [i // 8 for i in at], [sha("".join(r)) for r in runs]
    return level[0], paths


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified, from rows of FIELDS."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [(sorted(groups[g], key=lambda x: x[:3]), *climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in names]
    root, tops = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for (_, _, h, r), path in zip(own, paths):
            steps = [*path, *top]
            text = r[4].translate(UPPER) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
            folded = leaf([*r[:4], text])
            for a, b in steps:
                folded = sha(a + folded + b)
            out.append((r[0], h, subroot, root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=str)


def asked(spark, where):
    return sorted((tuple(r) for r in queries.op12_merkle(spark, where).collect()), key=str)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_is_brute_force(spark, size):
    rows = [tuple(r) for r in table(spark, f"/root/testdata/{size}", "documents").select(*FIELDS).collect()]
    got = asked(spark, f"/root/testdata/{size}")
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}


def test_edges(spark, tmp_path):
    """Nulls everywhere, repeated rows and ids, groups of 1, 8, 9, 64, 65 and over one block, and many groups."""
    rows = [(None, None, None, None, None)] * 2 + [(1, "s", None, 3, "A"), (1, "s", None, 3, "B"), (1, None, "", 0, ""), (7, "é", "日本", -2, "Ü X")]
    rows += [(k, "s", f"g{n}", k, f"Text {k}") for n in (1, 8, 9, 64, 65, 1300) for k in range(n)]
    rows += [(k % 3, "s", f"many{k}", 1, "Z") for k in range(600)] + [(5, "s", "copies", 1, "Q")] * 40
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, name int, `a.b c` string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert asked(spark, str(tmp_path)) == brute(rows)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert asked(spark, f"{tmp_path}/none") == []
    docs.where("doc_id = 7").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert asked(spark, f"{tmp_path}/one") == brute([r for r in rows if r[0] == 7])


def test_proofs_are_made_without_joins_of_leaves(spark):
    blocks = spark.createDataFrame([(True, "x", 0, 3, "h", [("l", "r")])], "named boolean, name string, block long, n long, root string, path array<struct<l:string,r:string>>")
    nodes = spark.range(3).select(F.lit(True).alias("named"), F.lit("x").alias("name"), F.lit(3).cast("long").alias("n"), F.col("id").alias("rank"), F.col("id").cast("string").alias("h"))
    rolled = merkle._rolled(nodes, F.lit(0))
    opened = merkle._opened(merkle._met(rolled, blocks.drop("n"), ["root"]), ["root"])
    assert sorted((r.rank, [tuple(p) for p in r.path]) for r in opened.collect()) == [(0, [("", "12"), ("l", "r")]), (1, [("0", "2"), ("l", "r")]), (2, [("01", ""), ("l", "r")])]
    assert "Join" not in opened._jdf.queryExecution().executedPlan().toString()
