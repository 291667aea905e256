"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, ``spark.checkpoint.dir``; where it is unset, a temporary one if Spark runs in this process alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lithoscope-"))
    return _own_dir[0]


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors recompute nothing before it."""
    return _written(df, staging_path(df.sparkSession, label))


class Scratch:
    """Tables in the shared folder that are needed only until an operator's result is staged."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.count = spark, staging_path(spark, label), 0
        self.sent: list = []

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.path}/{self.count}-{label}")

    def broadcast(self, value):
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def tidy(self) -> None:
        """Let go of what finished jobs left: plans and statuses in the driver, and shuffle files, which stay until it collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        """Delete the tables and release what was broadcast; nothing that reads them may run afterwards."""
        for one in self.sent:
            one.unpersist()
        self.sent = []
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


BATCH_BYTES, SLICE_BYTES = 8 << 20, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, as a row may hold a very long text; the session's own bound stays where it is lower."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = spark.conf.get(key, "64m").strip()
    now = 0 if text.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_kept: dict[str, tuple] = {}


def kept(kind: str, key, make: Callable):
    """What ``make()`` gave for ``key``, held by the worker from task to task; one of a kind, until another operator's task comes."""
    if kind not in _kept or _kept[kind][0] != key:
        _kept.pop(kind, None)
        _kept[kind] = (key, make())
    return _kept[kind][1]


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = SLICE_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in slices in which the texts of column ``at`` take about ``most`` bytes (or one text more).

    What the worker has ``kept`` of another kind than ``keep`` goes, and memory is handed back at the end.
    """
    for kind in [k for k in _kept if k != keep]:
        del _kept[kind]
    try:
        for batch in batches:
            if batch.num_rows:
                sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    yield batch.slice(a, b - a)
    finally:
        release()


def release() -> None:
    """Hand memory that this worker no longer uses back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows that agree in the columns ``keys``, one group after the other, of batches in which they follow each other."""
    held: list[pa.RecordBatch] = []
    first: tuple = ()

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            change |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(batch.column(batch.schema.get_field_index(k))[a].as_py() for k in keys)
            if held and own != first:
                yield joined()
                held = []
            first = own
            held.append(batch.slice(a, b - a))
    if held:
        yield joined()


def others(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df`` but those named (names count without case), whatever characters their names have."""
    gone = {c.lower() for c in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def mapped(df: DataFrame, run: Callable, more: str, keep: int | None = None) -> DataFrame:
    """``df`` through ``run`` (by ``mapInArrow``), which gives its first ``keep`` columns (all) and those that ``more`` declares.

    Within ``run`` columns go by place, as they have names there that need no quoting.
    """
    keep = len(df.columns) if keep is None else keep
    plain, made = df.toDF(*[f"_{k}" for k in range(len(df.columns))]), StructType.fromDDL(more)
    return plain.mapInArrow(run, StructType([*plain.schema.fields[:keep], *made])).toDF(*df.columns[:keep], *made.names)


def internal(columns: list[str], name: str) -> str:
    """``name``, or what it must be prolonged to so that it clashes with none of ``columns`` (names count without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds``; null ids fall into none."""
    return F.crc32(F.col(column).cast("string")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
