"""SAC (binary) and DYNA 1.2 (text) records."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of SAC: words of the header (70 floats, 40 integers, 192 characters) and the value that means undefined.
HEADER, UNDEFINED = 632, -12345


def parse_sac(data: bytes) -> dict:
    """The version word tells the byte order."""
    order = "<" if struct.unpack("<i", data[304:308])[0] in (6, 7) else ">"
    floats, ints = struct.unpack(f"{order}70f", data[:280]), struct.unpack(f"{order}40i", data[280:440])
    text = lambda k: data[440 + 8 * k : 448 + 8 * k].decode("ascii", "replace").strip("\0 ").replace(str(UNDEFINED), "")
    start = None
    if ints[0] != UNDEFINED:
        start = datetime(ints[0], 1, 1) + timedelta(days=ints[1] - 1, hours=ints[2], minutes=ints[3], seconds=ints[4], milliseconds=ints[5])
        start += timedelta(seconds=floats[5] if floats[5] != UNDEFINED else 0)
    station, network, channel, location = text(0), text(21), text(20), text(3)
    values = np.frombuffer(data, f"{order}f4", ints[9], HEADER).astype(float)
    return {"sid": f"{network}.{station}.{location}.{channel}", "t0": start, "delta": round(float(floats[0]), 9), "data": values}


def build_sac(sid: str, t0: datetime, delta: float, values: np.ndarray) -> bytes:
    floats, ints = [float(UNDEFINED)] * 70, [UNDEFINED] * 40
    floats[0], floats[5], floats[6] = delta, 0.0, delta * (len(values) - 1)
    ints[:6] = t0.year, t0.timetuple().tm_yday, t0.hour, t0.minute, t0.second, t0.microsecond // 1000
    ints[6], ints[9], ints[15], ints[35] = 6, len(values), 1, 1
    texts = [str(UNDEFINED).encode().ljust(8)] * 24
    network, station, location, channel = (x.encode() for x in sid.split("."))
    texts[0], texts[21], texts[20], texts[3] = station.ljust(8), network.ljust(8), channel.ljust(8), (location or str(UNDEFINED).encode()).ljust(8)
    return struct.pack("<70f", *floats) + struct.pack("<40i", *ints) + b"".join(texts) + np.asarray(values, "<f4").tobytes()


def read_sac(spark: SparkSession, path: str) -> DataFrame:
    schema = pa.schema([("sid", pa.string()), ("t0", pa.timestamp("us")), ("delta", pa.float64()), ("data", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_sac(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "sid string, t0 timestamp_ntz, delta double, data array<double>")


#: Fixed value of DYNA: lines of its header.
DYNA_HEADER = 64


def read_dyna(spark: SparkSession, path: str) -> DataFrame:
    """sid, t0 (text of the header), delta, data; one file is one record."""
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    head = lambda key: F.trim(F.regexp_extract("value", rf"(?m)^{key}:[ ]*(.*)$", 1))
    samples = F.filter(F.slice(lines, DYNA_HEADER + 1, 1 << 30), lambda x: F.trim(x) != "")
    return spark.read.text(path, wholetext=True).select(
        F.concat_ws(".", head("NETWORK"), head("STATION_CODE"), head("LOCATION"), head("STREAM")).alias("sid"),
        head("DATE_TIME_FIRST_SAMPLE_YYYYMMDD_HHMMSS").alias("t0"),
        head("SAMPLING_INTERVAL_S").cast("double").alias("delta"),
        F.transform(samples, lambda x: F.trim(x).cast("double")).alias("data"),
    )


def parse_dyna(text: str) -> dict:
    """One record of the format: sid, t0, delta, data."""
    lines = text.replace("\r", "").split("\n")
    head = dict(line.split(":", 1) for line in lines[:DYNA_HEADER] if ":" in line)
    known = {key.strip(): value.strip() for key, value in head.items()}
    start = None
    for form in ("%Y%m%d_%H%M%S.%f", "%Y%m%d_%H%M%S"):
        try:
            start = datetime.strptime(known.get("DATE_TIME_FIRST_SAMPLE_YYYYMMDD_HHMMSS", ""), form)
            break
        except ValueError:
            continue
    sid = ".".join(known.get(key, "") for key in ("NETWORK", "STATION_CODE", "LOCATION", "STREAM"))
    return {"sid": sid, "t0": start, "delta": float(known["SAMPLING_INTERVAL_S"]), "data": np.array([float(x) for x in lines[DYNA_HEADER:] if x.strip()])}


def build_dyna(sid: str, t0: datetime, delta: float, values: np.ndarray) -> bytes:
    network, station, location, stream = sid.split(".")
    known = (("NETWORK", network), ("STATION_CODE", station), ("LOCATION", location), ("STREAM", stream), ("SAMPLING_INTERVAL_S", repr(float(delta))), ("DATE_TIME_FIRST_SAMPLE_YYYYMMDD_HHMMSS", f"{t0:%Y%m%d_%H%M%S.%f}"), ("NDATA", str(len(values))))
    head = [f"{key}: {value}" for key, value in known]
    return "\n".join([*head, *["USER:"] * (DYNA_HEADER - len(head)), *(repr(float(v)) for v in values)]).encode()
