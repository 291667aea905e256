"""Token-ID output as a content-addressed store.

A rolling hash over the ids cuts each document's id stream into chunks, so that
equal passages give equal chunks wherever they start.  A chunk is addressed by
the SHA-256 of its payload and stored once.  A recipe per document, in ascending
doc_id order, lists its chunks and has the root of a Merkle tree over them; a
manifest has, for each range of documents, the root of a tree over their roots.
A reader makes all of these again and so verifies what it puts together.

Files of a store, all of them Parquet:

* ``chunks``: digest, n_ids, width (bytes an id), payload (little-endian ids);
* ``recipes``: bucket, position, doc_id, n_tokens, digests, lengths, root;
* ``manifest``: bucket, n_documents, n_tokens, start (ids before the bucket), root.

Defined results: a null text counts as empty, and an empty text is the end id
alone; repeated rows are documents of their own, ordered among themselves by
root; a null doc_id sorts first; further columns of the input are ignored; an
empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .common import Scratch, bounded_batches, partitions, slices, staged, staging_path
from .encoding import ENCODER, encoder

WINDOW, LEAST, MOST, MEAN_BITS, LEVEL = 16, 256, 4096, 10, 8
MULTIPLIER = 0x9E3779B97F4A7C15
CRC_POLYNOMIAL = 0xEDB88320  # of zlib's crc32, bits reversed


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of the 16 ids that end at each place (fewer at the front)."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        factor, step = MULTIPLIER, 1
        while step < WINDOW:
            longer = h.copy()
            longer[step:] += h[:-step] * np.uint64(factor)
            h, step, factor = longer, step * 2, factor * factor % (1 << 64)
    return h


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, counted from its own first id."""
    marks = np.flatnonzero(rolling_hash(ids) >> np.uint64(64 - MEAN_BITS) == 0) + 1
    first = np.searchsorted(marks, bounds)
    out = []
    for k in range(len(bounds) - 1):
        begin, end, ends = int(bounds[k]), int(bounds[k + 1]), []
        at = begin
        for mark in marks[first[k] : first[k + 1]].tolist():
            while mark - at > MOST:
                at += MOST
                ends.append(at - begin)
            if mark - at >= LEAST and mark < end:
                at = mark
                ends.append(at - begin)
        while end - at > MOST:
            at += MOST
            ends.append(at - begin)
        out.append([*ends, end - begin])
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary hash tree over ``digests``; an odd one moves up as it is."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    while len(level) > 1:
        odd = [level[-1]] if len(level) % 2 else []
        level = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])] + odd
    return level[0] if level else hashlib.sha256(b"").digest()


@F.pandas_udf(BinaryType())
def root_of(digests: pd.Series) -> pd.Series:
    return digests.map(lambda d: merkle_root(list(d)))


ENCODED = "doc_id long, n_tokens long, root binary, chunks array<struct<digest:binary,n_ids:int,width:int,payload:binary>>"
_CHUNK = pa.struct([("digest", pa.binary()), ("n_ids", pa.int32()), ("width", pa.int32()), ("payload", pa.binary())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunks", pa.list_(_CHUNK))])


def encode_chunks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each document, with its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches, 1, keep=ENCODER):
            ids, bounds = enc.encode(batch.column(1))
            payload = pa.py_buffer(ids.astype(f"<u{enc.width}"))
            ends = cut_points(ids, bounds)
            each = np.fromiter(map(len, ends), np.int64, len(ends))
            last = np.concatenate([np.add(own, bounds[k]) for k, own in enumerate(ends)])  # ends of all chunks, in the ids of the slice
            edges = np.concatenate([[0], last])
            places = pa.py_buffer((edges * enc.width).astype(np.int32))
            raw = memoryview(payload)
            digests = [hashlib.sha256(raw[x:y]).digest() for x, y in pairwise((edges * enc.width).tolist())]
            after = np.concatenate([[0], np.cumsum(each)])
            roots = [merkle_root(digests[x:y]) for x, y in pairwise(after.tolist())]
            n = len(last)
            chunks = pa.StructArray.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(np.diff(edges).astype(np.int32)), pa.array(np.full(n, enc.width, np.int32)), pa.Array.from_buffers(pa.binary(), n, [None, places, payload])], fields=list(_CHUNK)
            )
            columns = [batch.column(0), pa.array(np.diff(bounds)), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(pa.array(after.astype(np.int32)), chunks)]
            yield pa.RecordBatch.from_arrays(columns, names=_ENCODED.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode ``docs`` and write chunks, recipes and manifest below ``path``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "token-store")
    encoded = scratch.staged(encode_chunks(docs, tokenizer), "encoded")
    (
        encoded.select(F.explode("chunks").alias("c"))
        .select("c.*")
        .groupBy("digest")
        .agg(F.first("n_ids").alias("n_ids"), F.first("width").alias("width"), F.first("payload").alias("payload"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/chunks")
    )
    ordered = (
        encoded.select("doc_id", "n_tokens", F.col("chunks.digest").alias("digests"), F.col("chunks.n_ids").alias("lengths"), "root")
        .repartitionByRange(partitions(spark), F.col("doc_id"), F.col("root"))
        .withColumn("bucket", F.spark_partition_id())
    )
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "root")).cast("long") - 1
    ordered.withColumn("position", place).write.option("compression", "zstd").parquet(f"{path}/recipes")
    scratch.clear()
    recipes = spark.read.parquet(f"{path}/recipes").select("bucket", "position", "n_tokens", "root")
    _totals(recipes).write.parquet(f"{path}/manifest")


def _totals(documents: DataFrame) -> DataFrame:
    """bucket, n_documents, n_tokens, start, root of ``documents`` (bucket, position, n_tokens, root): what a manifest holds.

    The root of a bucket is that of a Merkle tree over its documents' roots, made
    by levels: ``2 ** LEVEL`` neighbours become one node, so no row holds more.
    """
    totals = documents.groupBy("bucket").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    most, level = (documents.agg(F.max("position")).first()[0] or 0) + 1, documents.select("bucket", "position", "root")
    while True:
        below = F.array_sort(F.collect_list(F.struct("position", "root"))).alias("below")
        parts = level.groupBy("bucket", F.shiftright("position", LEVEL).alias("above")).agg(below)
        level = parts.select("bucket", F.col("above").alias("position"), root_of(F.col("below.root")).alias("root"))
        most = -(-most >> LEVEL)
        if most <= 1:
            break
    tops = level.where("position = 0").groupBy("bucket").agg(F.max("root").alias("root"))
    before = F.sum("n_tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    return totals.join(tops, "bucket", "left").withColumn("start", F.coalesce(before, F.lit(0)))


def _shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each crc32 as it counts in that of a text that goes on for ``n_bytes`` more."""

    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, out = a.copy(), b.copy(), np.zeros_like(a)
        for _ in range(32):
            out ^= np.where(a >> np.uint64(31) & np.uint64(1), b, np.uint64(0))
            a = a << np.uint64(1) & np.uint64(0xFFFFFFFF)
            b = b >> np.uint64(1) ^ np.where(b & np.uint64(1), np.uint64(CRC_POLYNOMIAL), np.uint64(0))
        return out

    out, left = crc.astype(np.uint64), n_bytes.astype(np.uint64)
    power = np.full(1, 1 << 23, np.uint64)  # x to the 8th, bits reversed: one byte
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = times(np.broadcast_to(power, odd.sum()), out[odd])
        power, left = times(power, power), left >> np.uint64(1)
    return out


@F.pandas_udf(LongType())
def crc_share(crc: pd.Series, n_bytes: pd.Series) -> pd.Series:
    return pd.Series(_shifted(crc.to_numpy(), n_bytes.to_numpy()).astype(np.int64))


CHECKED = "digest binary, n_stored long, crc long, sound boolean"
_CHECKED = pa.schema([("digest", pa.binary()), ("n_stored", pa.int64()), ("crc", pa.int64()), ("sound", pa.bool_())])


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, widths, payloads = (batch.column(i).to_pylist() for i in range(3))
        sound = [hashlib.sha256(p).digest() == d for p, d in zip(payloads, digests)]
        ids = [np.frombuffer(p if ok else b"", f"<u{w}") for p, w, ok in zip(payloads, widths, sound)]
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(crc, pa.int64()), pa.array(sound, pa.bool_())], schema=_CHECKED)


def _places(spark: SparkSession, path: str) -> DataFrame:
    """Every chunk of every document: bucket, position, doc_id, start, n_tokens, root, ordinal, digest, n_ids, after."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    before = F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    docs = (
        recipes.withColumn("within", F.coalesce(before, F.lit(0)))
        .join(manifest.select("bucket", F.col("start").alias("bucket_start")), "bucket")
        .withColumn("start", F.col("bucket_start") + F.col("within"))
    )
    return docs.select("bucket", "position", "doc_id", "start", "n_tokens", "root", F.posexplode(F.arrays_zip("digests", "lengths")).alias("ordinal", "c")).select(
        "bucket", "position", "doc_id", "start", "n_tokens", "root", "ordinal", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("n_ids")
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, by document: doc_id, start, n_tokens, ids_crc32, n_chunks, verified.

    Payloads stay where they are: each stored chunk is checked against its
    address and summed up once, and a document's crc32 is put together from
    those of its chunks.  ``verified``: every chunk is there and sound, the
    lengths agree, the Merkle root over the chunks is the recipe's, and the
    manifest made again from these roots is, for the document's range, the stored
    one, so that no recipe is lost, doubled, moved or changed.
    """
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "width", "payload").mapInArrow(_check_chunks, CHECKED)
    so_far = Window.partitionBy("bucket", "position").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        _places(spark, path)
        .join(chunks, "digest", "left")
        .withColumn("before", F.sum("n_ids").over(so_far))
        .withColumn("share", crc_share(F.coalesce("crc", F.lit(0)), 4 * (F.col("n_tokens") - F.col("before"))))
        .groupBy("bucket", "position", "doc_id", "start", "n_tokens", "root")
        .agg(
            F.bit_xor("share").alias("ids_crc32"),
            F.count("*").cast("long").alias("n_chunks"),
            F.sum("n_stored").alias("n_stored"),
            F.every(F.coalesce("sound", F.lit(False))).alias("sound"),
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "digest"))), lambda x: x["digest"]).alias("digests"),
        )
        .withColumn("made", root_of("digests"))
        .drop("digests")
    )
    found = staged(found, "summary")
    again = _totals(found.select("bucket", "position", "n_tokens", F.col("made").alias("root")))
    columns = ("bucket", "n_documents", "n_tokens", "start", "root")
    same = again.select(*columns).intersect(spark.read.parquet(f"{path}/manifest").select(*columns)).select("bucket").distinct().withColumn("range", F.lit(True))
    own = F.col("sound") & (F.col("n_stored") == F.col("n_tokens")) & (F.col("made") == F.col("root"))
    return found.join(same, "bucket", "left").select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", (own & F.coalesce("range", F.lit(False))).alias("verified"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents themselves, put together again: doc_id, start, ids (little-endian, ``width`` bytes each), width."""
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "width", "payload")
    joined = _places(spark, path).join(chunks, "digest")
    return (
        joined.groupBy("bucket", "position", "doc_id", "start")
        .agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("ordinal", "payload"))).alias("c"))
        .select("doc_id", "start", F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["payload"])).alias("ids"), "width")
    )


def encode_to_store(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a new store in the shared folder and return what is read back from it."""
    path = staging_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer)
    return read_summary(docs.sparkSession, path)
