"""Structured Streaming over event streams (sid, ts, v).

``ts`` is a timestamp with zone here: watermarks need one.  Late rows beyond the
watermark are dropped by Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "10 minutes"


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream, or one file of a folder by its name."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").option("recursiveFileLookup", "true").parquet(folder)


def windowed(stream: DataFrame, length: str, step: str | None = None, delay: str = DELAY) -> DataFrame:
    """begin, sid, n, total by tumbling or sliding windows."""
    window = F.window("ts", length, step) if step else F.window("ts", length)
    counted = stream.withWatermark("ts", delay).groupBy(window.alias("w"), "sid").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    return counted.select(F.col("w.start").alias("begin"), "sid", "n", "total")


def merged_segments(stream: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    """Segments of a source without a gap: begin, end, sid, n."""
    counted = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "sid").agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return counted.select(F.col("w.start").alias("begin"), "end", "sid", "n")


def last_values(stream: DataFrame, size: int) -> DataFrame:
    """A ring buffer for each source: after each batch its last ``size`` values, oldest first."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for rows in batches:
            held = sorted(held + list(zip(rows["ts"].astype("int64").tolist(), rows["v"].tolist())))[-size:]
        state.update(([t for t, _ in held], [v for _, v in held]))
        yield pd.DataFrame({"sid": [key[0]], "buffer": [[v for _, v in held]]})

    return stream.groupBy("sid").applyInPandasWithState(update, "sid long, buffer array<double>", "ts array<long>, v array<double>", "update", GroupStateTimeout.NoTimeout)


def run_to_end(result: DataFrame, mode: str, folder: str) -> DataFrame:
    """Read everything there is, keep what the last batch put out, and return it."""
    spark, path = result.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    started = result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    started.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("b")).first().b
        out = out.where(F.col("batch") == last)
    return out.drop("batch")
