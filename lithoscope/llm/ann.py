"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is centred, scaled to length one and rotated; the signs of its
coordinates are its code, kept as packed bits beside two correction scalars:
the length of the centred vector and the inner product of the unit vector with
its own code.  From these an unbiased estimate of any inner product follows, with
a bound on its error that shrinks with the square root of the number of bits
(``ROTATIONS`` bits a dimension).  In a block of vectors the exact products of
the ``FIRST`` most promising ones set a query's reach, the k-th best of them;
every vector whose upper bound comes up to it is ranked by the exact product.
The k-th best in the sample below is a reach to begin with.

Work and memory: the index is a table of blocks of at most ``block_rows``
vectors.  Queries are cut into blocks of at most ``query_rows`` too, and each
block of queries is broadcast (``query_rows`` times the dimension, a fixed size)
and run against the whole index; results of a pass are k rows for each query and
block, merged by a window that Spark cuts to k rows before it shuffles.

The centre comes from a bounded sample of ``sample_rows`` vectors (the ones with
the smallest hashes of their ids); every vector is indexed.

Defined results: vectors null, of zero length, or with a null or non-finite
component take no part, as query or as candidate; nor do those whose number of
components is not the most frequent one (the larger on a tie).  Ties go to the
smaller id.  A query never finds rows of its own id.  Repeated rows are candidates
each on its own, and queries of one id are answered together, by its best k.
Null ids take no part.  An empty table gives no rows.  Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged

BLOCK_ROWS, QUERY_ROWS, SAMPLE_ROWS = 32_768, 4_096, 4_096
ROTATIONS, SIGMAS, FIRST, SEED = 4, 3.5, 64, 20


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrices side by side, the same in every task: each gives one bit a dimension."""
    rng, turns = np.random.default_rng(seed), []
    for _ in range(ROTATIONS):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        turns.append(q * np.sign(np.diag(r)))
    return np.concatenate(turns, axis=1) / np.sqrt(ROTATIONS)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths of the centred vectors, and inner products of the unit vectors with their codes."""
    centred = vectors - centre
    length = np.linalg.norm(centred, axis=1)
    unit = (centred / np.where(length > 0, length, 1)[:, None]) @ turn
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(turn.shape[1])


def usable(df: DataFrame) -> DataFrame:
    """id, v (array of double) of the vectors that take part."""
    rows = df.select("id", F.col("v").cast("array<double>").alias("v")).where(
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).select("dim")
    found = dim.first()
    return rows.where(F.size("v") == (found.dim if found else 0))


INDEX = "ids binary, vectors binary, codes binary, lengths binary, fits binary"
_INDEX = pa.schema([(n, pa.binary()) for n in ("ids", "vectors", "codes", "lengths", "fits")])


def build_index(vectors: DataFrame, centre: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ids, vectors, packed codes and correction scalars, as raw numbers; ``vectors``: id, v."""
    dim = len(centre)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, ids, rows, held = rotation(dim), [], [], 0

        def block() -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(rows)
            codes, lengths, fits = encode(v, centre, turn)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (i, v, codes, lengths, fits)], schema=_INDEX)

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                if held and held + part.num_rows > block_rows:
                    yield block()
                    ids, rows, held = [], [], 0
                ids.append(part.column(0).to_numpy().astype("<i8"))
                rows.append(part.column(1).flatten().to_numpy().reshape(-1, dim))
                held += part.num_rows
        if held:
            yield block()

    return vectors.mapInArrow(blocks, INDEX)


FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search_block(q_ids, queries, floor, ids, vectors, codes, lengths, fits, centre, turn, k, sigmas):
    """Best k of one block for each query: arrays of query number, id and score."""
    dim, n = turn.shape[1], len(ids)
    scale = lengths / np.where(fits > 0, fits, 1)
    spread = scale * np.sqrt(np.maximum(1 - fits**2, 0)) / np.sqrt(max(dim - 1, 1))
    # one product gives the upper bounds: estimate of the centred part, its margin, and the part of the centre
    right = np.empty((n, dim + 2), np.float32)
    right[:, :dim] = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) * (scale / np.sqrt(dim))[:, None]
    right[:, dim], right[:, dim + 1] = sigmas * spread, 1
    found = []
    step = max(1, (2 << 20) // max(n, 1))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        norm = np.linalg.norm(q, axis=1)
        upper = np.concatenate([q @ turn, norm[:, None], (q @ centre)[:, None]], axis=1).astype(np.float32) @ right.T
        reach = floor[at : at + step]
        if n > FIRST:
            # the k-th exact product among the most promising ones, one to spare for the query itself
            first = np.argpartition(-upper, FIRST, axis=1)[:, :FIRST]
            exact = (q[:, None, :] * vectors[first]).sum(axis=2) - 1e-9 * norm[:, None] * lengths.max(initial=0)
            reach = np.maximum(reach, np.partition(exact, FIRST - k - 1, axis=1)[:, FIRST - k - 1]) if FIRST > k else reach
            np.put_along_axis(upper, first, np.inf, axis=1)  # they stay, so that k are found whatever the bounds say
        who, which = np.nonzero(upper >= (reach - 1e-4 * norm * lengths.max(initial=0))[:, None])
        parts = []
        for part in range(0, len(who), 1 << 17):
            a, b = who[part : part + (1 << 17)], which[part : part + (1 << 17)]
            score = exact_products(q[a], vectors[b])
            other = ids[b] != q_ids[at + a]
            parts.append((a[other] + at, ids[b][other], score[other]))
            if len(parts) > 8:
                parts = [_first_k(*map(np.concatenate, zip(*parts)), k)]
        if parts:
            found.append(_first_k(*map(np.concatenate, zip(*parts)), k))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component on: equal vectors have equal scores."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _first_k(q, ids, score, k):
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[rank < k], ids[rank < k], score[rank < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, sigmas: float = SIGMAS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` (id, v) for each of ``queries`` (id, v)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = staged(usable(vectors), "vectors")
    sample = np.array([r.v for r in base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").collect()])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centre = sample.mean(axis=0)
    dim = len(centre)
    index = staged(build_index(base, centre, block_rows), "codes")
    asked = queries.select("id", F.col("v").cast("array<double>").alias("v")).where(F.size("v") == dim).select("id", "v")
    asked = staged(usable(asked), "queries")
    blocks = -(-asked.count() // query_rows) or 1
    passes = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)) == b).collect()
        found = _one_pass(index, rows, sample, centre, k, sigmas)
        passes = found if passes is None else passes.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return passes.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_pass(index: DataFrame, rows: list, sample: np.ndarray, centre: np.ndarray, k: int, sigmas: float) -> DataFrame:
    q_ids, q = np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows]).reshape(len(rows), len(centre))
    floor = np.full(len(q), -np.inf)
    for at in range(0, len(q) if len(sample) > k + 1 else 0, 256):
        part = q[at : at + 256] @ sample.T
        # one to spare for the query itself, and a little for the order of summation
        floor[at : at + 256] = np.partition(part, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1] - 1e-9 * np.abs(part).max(axis=1)
    sent = index.sparkSession.sparkContext.broadcast((q_ids, q, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q_ids, q, floor), dim = sent.value, len(centre)
        turn = rotation(dim)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors, codes, lengths, fits = (batch.column(c)[i].as_py() for c in range(5))
                ids = np.frombuffer(ids, "<i8")
                n = len(ids)
                got = _search_block(
                    q_ids, q, floor, ids, np.frombuffer(vectors).reshape(n, dim), np.frombuffer(codes, np.uint8).reshape(n, -1), np.frombuffer(lengths), np.frombuffer(fits), centre, turn, k, sigmas
                )
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[got[0]]), pa.array(got[1]), pa.array(got[2])], schema=_FOUND)

    return index.mapInArrow(run, FOUND)
