"""N-gram Jaccard join over parity sketches.

A document's set holds the hashes of its distinct word shingles.  Two sets of
sizes a and b with ``100 * common >= percent * union`` differ in at most
``(a + b) * (100 - percent) / (100 + percent)`` members.  A sketch is a row of
words of ``WORD_BITS`` bits; every member flips one bit of one word, so the
number of bits in which two sketches differ never exceeds the number of members
in which the sets differ.  A band's sketches have ``SPARE`` more words, as a
share, than members may differ, so linked sets agree in a known number of words
at least: a word is the join key, and a set with fewer recurring words than that
number is linked with nothing.  Sets are sketched for size bands, and a set near
the upper end of its band for the next one too, so linked sets meet in one band.
Sets of equal size too small to differ at all are linked only if equal.

The join runs in these steps, none of which lists all pairs of a group:

1. Documents with the same set (128-bit fingerprint) form a class; only its
   smallest id goes on, to be sketched in a second pass over the texts.
2. Words that recur are counted; classes with too few of them go.
3. Every class is paired with one other, the first in a random order of all that
   share a word with it: one pair a class.  Pairs are checked by Hamming
   distance, then exactly, and components of the links that hold are found.
4. Groups that still hold several components are searched for spanning pairs, in
   blocks of at most ``BLOCK`` members: the classes of a group's largest component
   are compared with the others, not with each other.  Of all pairs whose sketches
   do not rule out a link only those are kept that join two components.  They are
   checked exactly; in groups where some fail, the search is repeated without
   them.  When none fails, every pair that could link is linked or in one component.
5. Groups left then are settled with the sets of their members at hand.  Near
   copies meet in nearly as many groups as they have words, so groups that have
   members in common are settled as one pool where that takes fewer rows.

So the links found connect the same documents as all links would.

Defined results: texts that are null or without words have empty sets, linked
with nothing; fewer words than a shingle make one shingle of all of them; ties go
to the smallest doc_id; rows that repeat a doc_id count as one document per
distinct set, each row reporting its own set; a null doc_id links like any other
but is no component's smallest; further columns are ignored, and kept by
``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import bit_filter
from .common import Scratch, bounded_batches, groups, others, partitions, release, slices, staged
from .components import components
from .words import mixed, shingle_sets

RATIO, BLOCK, BLOOM_BITS, WORD_BITS, SPARE = 1.5, 2048, 1 << 23, 8, 0.25
#: Searches by sketch before sets are looked at side by side, with how many forests each; bytes of the sets of a block.
FORESTS, SET_BYTES = (1, 8), 16 << 20


class Bands:
    """Size bands for one threshold; band b holds sizes from edges[b] up to edges[b + 1]."""

    def __init__(self, percent: int):
        self.percent = percent
        edge = next((s for s in range(1, 1000) if (2 * s - 1) * (100 - percent) >= 100 + percent), 1000)
        self.edges = [edge]
        while self.edges[-1] < 1 << 40:
            self.edges.append(int(self.edges[-1] * RATIO) + 1)

    def most_apart(self, both: int) -> int:
        """How many members two linked sets of ``both`` members together can differ in."""
        return both * (100 - self.percent) // (100 + self.percent)

    def words(self, band: int) -> int:
        """More than the largest difference in the band."""
        apart = self.most_apart(2 * (self.edges[band + 1] - 1))
        return apart + 2 + int(apart * SPARE)

    def agreeing(self, band: int, size: int) -> int:
        """In how many words a set of this size agrees at least with any it is linked with in the band."""
        largest = min(size * 100 // self.percent, self.edges[band + 1] - 1)
        return self.words(band) - self.most_apart(size + largest)

    def of(self, size: int) -> list[int]:
        """The bands a set of this size is sketched for: its own, and all that a larger set which it may link with lies in."""
        own, last = (int(np.searchsorted(self.edges, s, side="right")) - 1 for s in (size, size * 100 // self.percent))
        return list(range(max(own, 0), last + 1))


def sketch(members: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit sketch (one bit flipped by each member) and the exclusive-or of the members' hashes, by word."""
    place = ((members >> np.uint64(32)) % np.uint64(words)).astype(np.int64)
    flips = np.bincount(place * WORD_BITS + (members & np.uint64(WORD_BITS - 1)).astype(np.int64), minlength=-(-words * WORD_BITS // 64) * 64) & 1
    bits = np.packbits(flips.astype(np.uint8), bitorder="little").view("<u8")
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(words))
    full = np.concatenate([members[order], np.zeros(1, np.uint64)])
    sums = np.bitwise_xor.reduceat(full, np.minimum(starts, len(members)))
    sums[np.bincount(place, minlength=words) == 0] = 0
    return bits, sums


def _print(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def printed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (members), fp (fingerprint of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(_print, sets), pa.binary())], names=["doc_id", "n", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, fp binary")


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS))


def _filter_of(ids: DataFrame, scratch: Scratch):
    """A broadcast bit filter of fixed size over the column doc_id."""
    words = ids.select(_place().alias("p")).groupBy(F.expr("cast(p div 64 as int) w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    seen = np.zeros(BLOOM_BITS // 64, np.int64)
    for r in words.collect():  # BLOOM_BITS / 64 rows at most
        seen[r.w] = r.bits
    return scratch.broadcast(seen)


def _chosen(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").withColumn("place", _place())


def _hits(batches: Iterator[pa.RecordBatch], seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        place = batch.column(2).to_numpy()
        hit = batch.take(pa.array(np.flatnonzero(seen[place // 64] >> (place % 64) & 1)))
        if hit.num_rows:
            yield hit


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """A list of longs for each part."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)))


SKETCHES = "fp binary, n long, band int, need int, bits array<long>, keys array<long>"


def sketched(docs: DataFrame, sent, size: int, percent: int) -> DataFrame:
    """A row for each class and band, of the documents that a filter may have: need (recurring words it must have), bits, keys (none for words left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in _hits(batches, sent.value):
            rows, every_bits, every_keys = [], [], []
            for members in shingle_sets(batch.column(1), size):
                for band in bands.of(len(members)) if len(members) else ():
                    words, agreeing = bands.words(band), bands.agreeing(band, len(members))
                    bits, sums = sketch(members, words)
                    full = np.flatnonzero(sums)
                    need = agreeing - (words - len(full))
                    used = full if need > 0 else np.arange(words)  # with so many empty words, two sets may agree in empty ones only
                    with np.errstate(over="ignore"):
                        every_keys.append(mixed(mixed(sums[used]) + used.astype(np.uint64) * np.uint64(64) + np.uint64(band)))
                    every_bits.append(bits)
                    rows.append((_print(members), len(members), band, max(1, need)))
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, _lists(every_bits), _lists(every_keys)], names=["fp", "n", "band", "need", "bits", "keys"])

    return _chosen(docs).mapInArrow(run, SKETCHES)


def recurring(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """key, band, fp of the words that recur, of classes that have as many of them as a link takes; what a bit filter lets through besides does no harm."""

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.sort(batch.column(0).flatten().to_numpy())
            heads = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1 if len(keys) else 0) != 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[heads]), pa.array(np.diff(heads, append=len(keys)))], names=["key", "times"])
        release()

    # most words occur once: they are summed up in a batch, which is enough for hot ones, and then not again before they are dealt out
    times = sketches.select("keys").mapInArrow(occurring, "key long, times long").repartition(partitions(sketches.sparkSession), "key")
    counted = times.groupBy("key").agg(F.sum("times").alias("times")).where("times > 1").select("key")
    known = scratch.broadcast(bit_filter(counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = part.column(3).flatten().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), np.diff(part.column(3).offsets.to_numpy()))
                hit = known.value.may_have(keys)
                hit &= (np.bincount(owner[hit], minlength=part.num_rows) >= part.column(2).to_numpy())[owner]
                rows = pa.array(owner[hit])
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), *(part.column(c).take(rows) for c in (1, 2, 0))], names=["key", "band", "need", "fp"])
        release()

    # a class that the filter of documents let through twice has each word twice
    found = sketches.select("fp", "band", "need", "keys").mapInArrow(run, "key long, band int, need int, fp binary").distinct()
    found = scratch.staged(found, "words")
    for _ in range(2):
        shared = found.groupBy("key").count().where("count > 1").select("key")
        left = found.join(shared, "key", "left_semi")
        enough = left.groupBy("fp", "band").agg(F.count("*").alias("count"), F.first("need").alias("need")).where("count >= need").select("fp", "band")
        found = scratch.staged(left.join(enough, ["fp", "band"], "left_semi"), "words")
    return found.select("key", "band", "fp")


def may_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sketches do not rule out a link in some band."""
    side = lambda p: sketches.select(F.col("fp").alias(p), "band", F.col("n").alias(f"{p}_n"), F.col("bits").alias(f"{p}_bits"))
    apart = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    joined = pairs.join(side("a"), "a").join(side("b"), ["b", "band"])
    return joined.where(apart * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)).select("a", "b").distinct()


def sets_of(classes: DataFrame, docs: DataFrame, firsts: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """fp, members of distinct ``classes`` (fp).

    Sets are made again from the texts of one document of each class concerned.
    A bit filter of fixed size keeps most other texts from being cut up; what it
    lets through in error falls to the join.
    """
    ends = classes.join(firsts.select("fp", "doc_id"), "fp")
    sent = _filter_of(ends, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _hits(batches, sent.value):
            sets = shingle_sets(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_print, sets), pa.binary()), _lists(sets)], names=["doc_id", "fp", "members"])

    # a repeated doc_id may stand for several sets, and one set for several rows; a class may have no doc_id
    wanted = ends.select(F.col("fp").alias("end"), F.col("doc_id").alias("first_id"))
    made = _chosen(docs).mapInArrow(run, "doc_id long, fp binary, members array<long>")
    members = made.join(wanted, (F.col("fp") == F.col("end")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["fp"]).select("fp", "members")
    return scratch.staged(members, "sets")


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, by the sets themselves."""
    members = sets_of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), docs, firsts, size, scratch)
    side = lambda p: members.select(F.col("fp").alias(p), F.col("members").alias(f"{p}_members"))
    common, both = F.size(F.array_intersect("a_members", "b_members")), F.size("a_members") + F.size("b_members")
    return scratch.staged(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (100 * common >= percent * (both - common)).alias("linked")), "checked")


SPANNING = "key long, a binary, b binary"


def _spanning(rows: pa.RecordBatch, found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """The pairs ``found`` among ``rows`` of one group."""
    key = rows.column(rows.schema.get_field_index("key"))[0].as_py()
    return pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), *(pa.array([f[c] for f in found], pa.binary()) for c in range(2))], names=["key", "a", "b"])


class _Group:
    """Rows of one (key, i, j): which of them are in one component, and which pairs are ruled out."""

    def __init__(self, batch: pa.RecordBatch, percent: int):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.fps, self.percent = column("fp").to_pylist(), percent
        self.bits = column("bits").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        self.n, self.side = column("n").to_numpy(), column("side").to_numpy()
        self.root = column("label").dictionary_encode().indices.to_numpy().copy()
        self.same = column("i")[0].as_py() == column("j")[0].as_py()
        known = {fp: k for k, fp in enumerate(self.fps)}
        self.failed: dict[int, list[int]] = {}
        for k, others in enumerate(column("failed").to_pylist()):
            for other in others or ():
                if other in known:
                    self.failed.setdefault(k, []).append(known[other])
                    self.failed.setdefault(known[other], []).append(k)

    def forest(self) -> Iterator[tuple[int, int]]:
        """Pairs of rows that the sketches do not rule out, enough to join all components that such pairs join; each row takes its likeliest partner in a component."""
        root = self.root.copy()
        for k in range(len(self.fps)):
            others = np.arange(k + 1, len(root)) if self.same else np.flatnonzero(self.side == 1) if self.side[k] == 0 else np.empty(0, int)
            others = others[root[others] != root[k]]
            if k in self.failed:
                others = np.setdiff1d(others, self.failed[k])
            if not len(others):
                continue
            apart = np.bitwise_count(self.bits[others] ^ self.bits[k]).sum(axis=1, dtype=np.int64)
            both = self.n[others] + self.n[k]
            near = apart * (100 + self.percent) <= both * (100 - self.percent)
            others, likely = others[near], (apart / both)[near]
            for other in others[np.argsort(likely, kind="stable")].tolist():
                if root[other] != root[k]:
                    root[root == root[other]] = root[k]
                    yield k, other

    def search(self, forests: int) -> Iterator[tuple[bytes, bytes]]:
        """Spanning pairs of ``forests`` forests that share none."""
        for _ in range(forests):
            found = list(self.forest())
            if not found:
                return
            for a, b in found:
                self.failed.setdefault(a, []).append(b)
                self.failed.setdefault(b, []).append(a)
                yield min(self.fps[a], self.fps[b]), max(self.fps[a], self.fps[b])


    def settled(self, sets: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Links, checked by the sets at once, that join all components which links of this group join."""
        values, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        root = self.root.copy()
        for k in range(len(self.fps)):
            others = np.arange(k + 1, len(root)) if self.same else np.flatnonzero(self.side == 1) if self.side[k] == 0 else np.empty(0, int)
            others = others[root[others] != root[k]]
            if k in self.failed:
                others = np.setdiff1d(others, self.failed[k])
            apart = np.bitwise_count(self.bits[others] ^ self.bits[k]).sum(axis=1, dtype=np.int64)
            both = self.n[others] + self.n[k]
            near = apart * (100 + self.percent) <= both * (100 - self.percent)
            others, likely, own = others[near], (apart / both)[near], values[ends[k] : ends[k + 1]]
            for other in others[np.argsort(likely, kind="stable")].tolist():
                if root[other] != root[k]:
                    theirs = values[ends[other] : ends[other + 1]]
                    common = len(np.intersect1d(own, theirs, assume_unique=True))
                    if 100 * common >= self.percent * (len(own) + len(theirs) - common):
                        root[root == root[other]] = root[k]
                        yield min(self.fps[k], self.fps[other]), max(self.fps[k], self.fps[other])


def settled_links(members: DataFrame, percent: int) -> DataFrame:
    """a, b: links, checked, of groups as for ``spanning_pairs`` whose rows have their sets (``members``) beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["key", "i", "j"]):
            found = list(_Group(rows, percent).settled(rows.column(rows.schema.get_field_index("members"))))
            if found:
                yield _spanning(rows, found)
        release()

    dealt = members.repartition(partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(run, SPANNING).select("a", "b").distinct()


def spanning_pairs(members: DataFrame, percent: int, forests: int) -> DataFrame:
    """key, a, b: of the pairs in a group that may link, enough to join all components that such pairs join.

    ``members``: key, i, j, side (0: in block i, 1: in block j), fp, label, n,
    bits, failed (partners already ruled out).  Rows of one (key, i, j) are read
    in a row, 2 x BLOCK or so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["key", "i", "j"]):
            found = list(_Group(rows, percent).search(forests))
            if found:
                yield _spanning(rows, found)
        release()

    order = ["key", "i", "j", "fp"]
    dealt = members.repartition(partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, SPANNING)


def _ruled_out(failed: DataFrame) -> DataFrame:
    """fp, failed: each pair is kept by the end that has fewer, so that no list is long."""
    ends = failed.select(F.col("a").alias("fp")).union(failed.select("b")).groupBy("fp").count()
    side = lambda p: ends.select(F.col("fp").alias(p), F.col("count").alias(f"{p}_count"))
    fewer = F.col("a_count") <= F.col("b_count")
    held = failed.join(side("a"), "a").join(side("b"), "b").select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("fp"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    return held.groupBy("fp").agg(F.collect_set("other").alias("failed"))


def _blocks(labelled: DataFrame, rows: Column | None = None) -> DataFrame:
    """key, band, fp, label, i, j, side: the members of groups of several components, once for each pair of blocks they are compared in.

    A block has about ``rows`` members (BLOCK).

    The largest component's members have blocks of their own, which are compared
    with the others' blocks only.
    """
    rows = F.lit(BLOCK) if rows is None else rows
    parts = labelled.groupBy("key", "band", "label").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("fp")).alias("who"))
    open_keys = (
        parts.groupBy("key", "band")
        .agg(F.count("*").alias("parts"), F.sum("size").alias("total"), F.max(F.struct("size", "label")).alias("largest"), F.bit_xor("who").alias("who"))
        .where("parts > 1")
        # those with the same members are searched once
        .groupBy("band", "total", "who")
        .agg(F.min_by(F.struct("key", "largest"), "key").alias("one"))
        .select("band", "one.key", F.col("one.largest.label").alias("most"), F.ceil((F.col("total") - F.col("one.largest.size")) / rows).cast("int").alias("few_blocks"), F.ceil(F.col("one.largest.size") / rows).cast("int").alias("most_blocks"))
    )
    few, blocks = F.col("label") != F.col("most"), F.col("few_blocks") + F.col("most_blocks")
    own = F.when(few, F.pmod(F.xxhash64("fp"), F.col("few_blocks"))).otherwise(F.col("few_blocks") + F.pmod(F.xxhash64("fp"), F.col("most_blocks"))).cast("int")
    return (
        labelled.join(open_keys, ["key", "band"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(few, blocks).otherwise(F.col("few_blocks")) - 1)))
        .select("key", "band", "fp", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )


def pooled(searched: DataFrame, rows: Column, scratch: Scratch) -> DataFrame:
    """key, band, fp: groups (``searched``) that have members in common, directly or through others, as one, unless that takes more rows.

    ``rows``: about as many members make a block, and every member is needed once
    for each block that it is compared with.
    """
    node = F.concat("fp", F.encode(F.col("band").cast("string"), "utf-8"))
    nodes = searched.select("key", "band", "fp", node.alias("node"))
    tops = nodes.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("size"))
    pools = components(nodes.join(tops, "key").select("a", F.col("node").alias("b")).distinct(), scratch)
    placed = scratch.staged(nodes.join(pools, "node", "left").join(tops.select("key", "size"), "key").select("key", "band", "fp", F.coalesce("label", "node").alias("pool"), "size"), "pools")
    alone = placed.groupBy("pool", "band").agg(F.sum(F.ceil(F.col("size") / rows)).alias("alone"))
    whole = placed.select("pool", "band", "fp").distinct().groupBy("pool", "band").agg(F.count("*").alias("members"))
    fewer = whole.join(alone, ["pool", "band"]).select("pool", (F.col("members") * F.ceil(F.col("members") / rows) <= F.col("alone")).alias("fewer"))
    own = F.when(F.col("fewer"), F.xxhash64("pool")).otherwise(F.col("key"))
    return placed.join(fewer, "pool").select(own.alias("key"), "band", "fp").distinct()


def linked_classes(docs: DataFrame, firsts: DataFrame, sketches: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """node, label: the component of every fingerprint that is linked with another."""
    searched = recurring(sketches, scratch)
    turn = F.xxhash64("fp", F.lit(1)).alias("turn")
    leads = searched.groupBy("key").agg(F.min(turn).alias("turn"))
    chosen = searched.join(leads, "key").groupBy("fp").agg(F.min("turn").alias("turn")).join(searched.select(F.col("fp").alias("lead"), turn).distinct(), "turn")
    stars = chosen.where("fp <> lead").select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b")).distinct()
    checked = verified(scratch.staged(may_link(stars, sketches, percent), "pairs"), docs, firsts, size, percent, scratch)
    labels = components(checked.where("linked"), scratch)
    scratch.tidy()

    def opened(rows: Column | None = None) -> DataFrame:
        """Members of the groups that are still searched, with what is known of them."""
        labelled = searched.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("key", "band", "fp", F.coalesce("label", "fp").alias("label"))
        # sketches are looked up for members of open groups only, after these are known
        members = scratch.staged(_blocks(labelled, rows), "members")
        own = sketches.select("fp", "band", "n", "bits").join(members.select("fp", "band").distinct(), ["fp", "band"]).dropDuplicates(["fp", "band"])
        return members.join(own, ["fp", "band"]).join(_ruled_out(checked.where("not linked").select("a", "b")), "fp", "left")

    for forests in FORESTS:
        found = scratch.staged(spanning_pairs(opened(), percent, forests), "found")
        if found.isEmpty():
            return labels
        scratch.tidy()
        fresh = verified(scratch.staged(found.select("a", "b").distinct(), "pairs"), docs, firsts, size, percent, scratch)
        checked = checked.union(fresh)
        if not fresh.where("linked").isEmpty():
            labels = components(checked.where("linked"), scratch)
        wrong = fresh.where("not linked")
        if wrong.isEmpty():
            return labels
        # a group is done once all pairs chosen in it hold; only those with one that does not are searched again, for more at a time
        again = found.join(wrong.select("a", "b"), ["a", "b"], "left_semi").select("key").distinct()
        searched = scratch.staged(searched.join(again, "key", "left_semi"), "words")
        scratch.tidy()
    # in the groups that are left most pairs fail, so they are settled with the sets at hand, in blocks of as many as fit
    largest = F.element_at(F.array(*[F.lit(e) for e in Bands(percent).edges]), F.col("band") + 2)
    rows = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(SET_BYTES / 8 / largest)))
    searched = scratch.staged(pooled(searched, rows, scratch), "words")
    scratch.tidy()
    members = scratch.staged(opened(rows), "open")
    sets = sets_of(members.select("fp").distinct(), docs, firsts, size, scratch)
    links = scratch.staged(settled_links(members.join(sets, "fp"), percent), "links")
    scratch.tidy()
    return labels if links.isEmpty() else components(checked.where("linked").select("a", "b").union(links), scratch)


def near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, fp (class of equal sets), component_id, for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "near-duplicates")
    rows = staged(printed(docs, size), "sets")
    firsts = scratch.staged(rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "firsts")
    # what the filter lets through besides is a class twice over, which does no harm
    sketches = scratch.staged(sketched(docs, _filter_of(firsts, scratch), size, percent), "sketches")
    labels = linked_classes(docs, firsts, sketches, size, percent, scratch).withColumnRenamed("node", "fp")
    joined = firsts.join(labels, "fp").select("fp", "doc_id", "label")
    least = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = firsts.join(joined.join(least, "label").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    known = staged(known, "classes")
    scratch.clear()
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "fp", F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "fp").join(known, "fp").select("doc_id", "n_shingles", "fp", "component_id").unionByName(empty)


def keep_one(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``docs`` without all but one document of each group of near duplicates, the one with the smallest doc_id.

    Rows that share a doc_id are one document and go or stay together, with the
    first of their sets that is a duplicate; those without doc_id or words stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), size, percent)
    losers = found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(losers, "doc_id", "left_anti").select(others(docs))
