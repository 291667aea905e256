"""Merkle manifest of a table: a nested-struct rollup over the digits of ranks.

Leaves of a group ascend by id and are numbered; a rank is written in base 8.  A
block holds the 512 leaves that agree in all but the last three digits.  Within
it, each digit is grouped away in turn, last one first: the nodes that agree in
the rest become one node, whose struct nests its children.  Blocks are the leaves
of the next round, until one node of each group is left; these, one for each
group, are rolled up likewise to the root.  Proofs come from the nested structs,
from the root down: the children of a node are given the texts of their siblings
by ``transform`` and are then exploded, three times a block.  A block meets the
path above it in a grouping by its key; no join is made with leaves or nodes.

A block's rows are bounded (512 leaves, their digests and what is carried), so no
group is collected whole: a group with a third of all rows is just more blocks.
Ranks come from a sort over ranges, ties dealt out by a running number, and from
counts by range.  Digests lie in the shared folder before they are sorted, so
texts are read once.

Defined results: a null field is ``-`` in its leaf, an empty one ``0:``; null ids
come first, then ascending; rows of one id go by their leaf's digest, which
decides everything they show; repeated rows are leaves of their own; a null group
is a group and comes before all others, which go bytewise; a lone leaf is its
group's root, and a lone group's root the root of all; an empty table gives no
rows.  Further columns are ignored; names count for nothing beyond those given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, staged

#: Bits of a digit (eight children a node) and digits that are grouped away within a block.
BITS, DIGITS = 3, 3
BLOCK = BITS * DIGITS
#: A node's group: whether it has a name, and the name.  Groups without one come first.
GROUP = ["named", "name"]
_ABOVE = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` if null, else its bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _digest(texts: Column) -> Column:
    return F.sha2(F.array_join(texts, ""), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda d, step: F.sha2(F.concat(step["l"], d, step["r"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return _digest(F.transform(path, lambda step: F.concat(step["l"], step["r"])))


def _numbered(scratch: Scratch, nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """``nodes`` with ``rank``, from 0, in their group by ``order``, and ``n``, the group's size."""
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id())
    by = [*GROUP, *order, "tie"]
    dealt = dealt.repartitionByRange(partitions(scratch.spark), *by).sortWithinPartitions(*by)
    lying = scratch.staged(dealt.withColumn("place", F.monotonically_increasing_id()).drop("tie"), f"{label}-sorted")
    lying = lying.withColumn("range", F.shiftrightunsigned("place", 33))
    # a group's rows in a range follow each other, so their first place and number tell their ranks
    counts = lying.groupBy(*GROUP, "range").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    own = Window.partitionBy(*GROUP)
    before = F.coalesce(F.sum("size").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*GROUP, "range", (before - F.col("first")).alias("shift"), F.sum("size").over(own).alias("n"))
    return lying.join(starts, [*GROUP, "range"]).withColumn("rank", F.col("place") + F.col("shift")).drop("place", "range", "shift")


def _rolled(nodes: DataFrame, kid: Column) -> DataFrame:
    """Blocks of the nodes (group, rank, n, h): group, block, n, h and the nested ``kids``, whose last ones hold ``kid``."""
    digit = lambda level: F.shiftright("rank", BITS * level).bitwiseAND((1 << BITS) - 1)
    rows = nodes.select(*GROUP, "n", F.shiftright("rank", BLOCK).alias("block"), *[digit(k).alias(f"d{k}") for k in range(DIGITS)], "h", kid.alias("below"))
    rows = rows.repartition(partitions(nodes.sparkSession), *GROUP, "block")
    for level in range(DIGITS):
        rest = [f"d{k}" for k in range(level + 1, DIGITS)]
        rows = rows.groupBy(*GROUP, "n", "block", *rest).agg(F.array_sort(F.collect_list(F.struct(f"d{level}", "h", "below"))).alias("below"))
        # a group that was one node before this level is done: its node goes up as it is
        rows = rows.withColumn("h", F.when(F.col("n") > 1 << BITS * level, _digest(F.col("below.h"))).otherwise(F.col("below")[0]["h"]))
    return rows.withColumnRenamed("below", "kids")


def _tree(scratch: Scratch, nodes: DataFrame, kid: Column, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of the tree over numbered nodes, lowest first, each with its blocks; and the groups' roots."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    rounds, current = [], nodes
    while True:
        rounds.append(scratch.staged(_rolled(current, kid), f"{label}-{len(rounds)}"))
        most = (most + (1 << BLOCK) - 1) >> BLOCK
        if most <= 1:
            return rounds, rounds[-1].select(*GROUP, "h")
        above = F.shiftright(F.col("n") + ((1 << BLOCK) - 1), BLOCK)
        current, kid = rounds[-1].select(*GROUP, F.col("block").alias("rank"), above.alias("n"), "h"), F.lit(0)


def _with_siblings(level: int) -> Callable[[Column, Column], Column]:
    """A child in ``kids``, by its place there, with the texts of its siblings' digests."""

    def kid(x: Column, at: Column) -> Column:
        text = lambda begin, length: F.array_join(F.slice(F.col("kids.h"), begin, length), "")
        siblings = F.struct(text(F.lit(1), at).alias("l"), text(at + 2, F.lit(1 << BITS)).alias("r"))
        return F.struct(x[f"d{level}"].alias("digit"), x["h"].alias("h"), x["below"].alias("kids"), siblings.alias("siblings"))

    return kid


def _opened(blocks: DataFrame, carried: list[str]) -> DataFrame:
    """The lowest nodes of blocks with a ``path``: group, rank, h, their payload as ``kids``, and their own path."""
    rows = blocks.withColumn("rank", F.col("block"))
    for level in reversed(range(DIGITS)):
        rows = rows.select(*GROUP, "n", "rank", "path", *carried, F.explode(F.transform("kids", _with_siblings(level))).alias("kid"))
        path = F.when(F.col("n") > 1 << BITS * level, F.concat(F.array("kid.siblings"), "path")).otherwise(F.col("path"))
        rows = rows.select(*GROUP, "n", (F.shiftleft("rank", BITS) + F.col("kid.digit")).alias("rank"), path.alias("path"), *carried, "kid.h", "kid.kids")
    return rows


def _met(blocks: DataFrame, paths: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks with the path above them, by one grouping."""
    key = [*GROUP, "block"]
    upper = paths.select(*key, "path", *carried)
    both = blocks.select(*key, "n", "kids").unionByName(upper, allowMissingColumns=True)
    return both.groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", *carried)])


def manifest(table: DataFrame, fields: Sequence[str | Column], group: str, order: str, carried: dict[str, Column] | None = None) -> DataFrame:
    """id, group, leaf, subroot, root, path of every row of ``table``, and what ``carried`` gives for it.

    ``fields``: columns whose values make a leaf.  ``order``: the column of ids.
    ``path``: array of ``l``, ``r``, the digests before and after the node among
    its siblings, joined, from the leaf to the root.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "merkle")
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    values = [quoted(f) if isinstance(f, str) else f for f in fields]
    extra = F.struct(F.lit(0).alias("_"), *[c.alias(name) for name, c in (carried or {}).items()])
    name = quoted(group).cast("string")
    leaves = table.select(name.isNotNull().alias("named"), F.coalesce(name, F.lit("")).alias("name"), quoted(order).alias("id"), leaf(values).alias("h"), extra.alias("extra"))
    nodes = _numbered(scratch, scratch.staged(leaves, "leaves"), ["id", "h"], "leaves")
    rounds, subroots = _tree(scratch, nodes, F.struct("id", "extra"), "leaves")

    every = subroots.select(F.lit(True).alias("named"), F.lit("").alias("name"), "h", F.struct(*GROUP).alias("group"))
    tops, root = _tree(scratch, _numbered(scratch, every, ["group"], "groups"), F.struct("group"), "groups")
    paths = root.select(*GROUP, F.lit(0).cast("long").alias("block"), F.lit(None).cast(_ABOVE).alias("path"), F.col("h").alias("root"))
    paths = paths.withColumn("path", F.coalesce("path", F.array().cast(_ABOVE)))
    for blocks in reversed(tops):
        opened = _opened(_met(blocks, paths, ["root"]), ["root"])
        paths = opened.withColumnRenamed("rank", "block")
    paths = paths.select("kids.group.*", F.lit(0).cast("long").alias("block"), "path", "root", F.col("h").alias("subroot"))
    paths = scratch.staged(paths, "groups")
    for k, blocks in enumerate(reversed(rounds)):
        opened = _opened(_met(blocks, paths, ["root", "subroot"]), ["root", "subroot"])
        paths = opened.withColumnRenamed("rank", "block")
        if k + 1 < len(rounds):
            paths = scratch.staged(paths, f"paths-{k}")
    found = F.when(F.col("named"), F.col("name"))
    result = staged(paths.select(F.col("kids.id").alias("id"), found.alias("group"), F.col("h").alias("leaf"), "subroot", "root", "path", *[F.col(f"kids.extra.{c}") for c in carried or {}]), "manifest")
    scratch.clear()
    return result
