"""MiniSEED 2 as a Spark source: fixed-length records in, one row each out, and the way back.

Records are independent, so a file is read as bytes by Spark and cut up in the
tasks; contiguous records are joined afterwards by a window over their source.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the format: encodings by number (plain ones with their numpy type), and the differences a word holds.
PLAIN = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
TEXT, STEIM1, STEIM2 = 0, 10, 11
STEIM2_WIDTHS = {(2, 1): (30, 1), (2, 2): (15, 2), (2, 3): (10, 3), (3, 0): (6, 5), (3, 1): (5, 6), (3, 2): (4, 7)}


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


def _differences(word: int, code: int, scheme: int) -> list[int]:
    """What one 32-bit word holds, by its two-bit code."""
    if code == 1:
        return [_signed(word >> s & 0xFF, 8) for s in (24, 16, 8, 0)]
    if scheme == STEIM1:
        return [_signed(word >> 16, 16), _signed(word & 0xFFFF, 16)] if code == 2 else [_signed(word, 32)]
    width, count = STEIM2_WIDTHS[code, word >> 30]
    return [_signed(word >> width * k & (1 << width) - 1, width) for k in range(count - 1, -1, -1)]


def decode_steim(payload: bytes, n: int, scheme: int, order: str = ">") -> np.ndarray:
    """Integrate the differences of 64-byte frames; the last sample must be the one the first frame announces."""
    steps: list[int] = []
    first = last = 0
    for frame in range(0, len(payload) - 63, 64):
        words = struct.unpack(f"{order}16I", payload[frame : frame + 64])
        begin = 1
        if frame == 0:
            first, last, begin = _signed(words[1], 32), _signed(words[2], 32), 3
        for k in range(begin, 16):
            if code := words[0] >> 2 * (15 - k) & 3:
                steps += _differences(words[k], code, scheme)
        if len(steps) >= n:
            break
    values = np.cumsum([first, *steps[1:n]]) if n else np.zeros(0, np.int64)
    if len(values) != n or (n and values[-1] != last):
        raise ValueError("compressed samples do not add up")
    return values


def encode_steim(values: np.ndarray, frames: int, scheme: int, previous: int | None = None) -> tuple[bytes, int]:
    """As many samples as fit into ``frames`` frames: the payload and their number."""
    values = np.asarray(values, np.int64)
    steps = np.diff(values, prepend=values[0] if previous is None else previous).tolist()
    if scheme == STEIM1:
        kinds = [(4, 8, 1, None), (2, 16, 2, None), (1, 32, 3, None)]
    else:
        kinds = [(7, 4, 3, 2), (6, 5, 3, 1), (5, 6, 3, 0), (4, 8, 1, None), (3, 10, 2, 3), (2, 15, 2, 2), (1, 30, 2, 1)]
    words, codes, at = [], [], 0
    room = frames * 15 - 2
    while at < len(steps) and len(words) < room:
        for count, width, code, tag in kinds:
            part = steps[at : at + count]
            if len(part) == count and all(-(1 << width - 1) <= s < 1 << width - 1 for s in part):
                word = 0
                for s in part:
                    word = word << width | s & (1 << width) - 1
                words.append(word | (tag << 30 if tag is not None else 0))
                codes.append(code)
                at += count
                break
        else:
            raise ValueError("difference too large for this encoding")
    if not at:
        return b"", 0
    cells = [(0, int(values[0]) & 0xFFFFFFFF), (0, int(values[at - 1]) & 0xFFFFFFFF), *zip(codes, words)]
    out = b""
    for k in range(0, len(cells), 15):
        part = cells[k : k + 15] + [(0, 0)] * (15 - len(cells[k : k + 15]))
        control = 0
        for code, _ in part:
            control = control << 2 | code
        out += struct.pack(">16I", control, *(w for _, w in part))
    return out.ljust(frames * 64, b"\0"), at


def _rate(factor: int, multiplier: int) -> float:
    rate = float(factor) if factor > 0 else -1.0 / factor if factor else 0.0
    return rate * multiplier if multiplier > 0 else -rate / multiplier if multiplier else 0.0


def parse_records(data: bytes) -> Iterator[dict]:
    """Records one after the other; the byte order follows from the year."""
    at = 0
    while at + 48 <= len(data):
        order = ">" if 1900 <= struct.unpack(">H", data[at + 20 : at + 22])[0] <= 2100 else "<"
        station, location, channel, network = (data[at + a : at + b].decode("ascii", "replace").strip() for a, b in ((8, 13), (13, 15), (15, 18), (18, 20)))
        year, day, hour, minute, second, _, tick, n, factor, multiplier = struct.unpack(f"{order}HHBBBBHHhh", data[at + 20 : at + 36])
        _, _, _, blockettes, correction, begin, blockette = struct.unpack(f"{order}BBBBiHH", data[at + 36 : at + 48])
        encoding, length, big, micro = STEIM1, 512, order, 0
        while blockette:
            kind, following = struct.unpack(f"{order}HH", data[at + blockette : at + blockette + 4])
            if kind == 1000:
                encoding, big, length = data[at + blockette + 4], ">" if data[at + blockette + 5] else "<", 1 << data[at + blockette + 6]
            elif kind == 1001:
                micro = struct.unpack("b", data[at + blockette + 5 : at + blockette + 6])[0]
            blockette = following
        payload = data[at + begin : at + length] if begin else b""
        start = datetime(year, 1, 1) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second, microseconds=tick * 100 + micro)
        if encoding in PLAIN:
            values = np.frombuffer(payload, big + PLAIN[encoding], n).astype(float)
        elif encoding in (STEIM1, STEIM2):
            values = decode_steim(payload, n, encoding, big).astype(float)
        elif encoding == TEXT:
            values = np.frombuffer(payload[:n], np.uint8).astype(float)
        else:
            raise ValueError(f"encoding {encoding} is not supported")
        rate = _rate(factor, multiplier)
        yield {"sid": f"{network}.{station}.{location}.{channel}", "t0": start, "delta": 1 / rate if rate else None, "data": values, "encoding": encoding}
        at += length


SCHEMA = "sid string, t0 timestamp_ntz, delta double, data array<double>, encoding int"
_SCHEMA = pa.schema([("sid", pa.string()), ("t0", pa.timestamp("us")), ("delta", pa.float64()), ("data", pa.list_(pa.float64())), ("encoding", pa.int32())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """sid, t0, delta, data, encoding of every record in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse_records(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _SCHEMA], schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def merge(records: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Records that follow each other within a share of a sample, as one: sid, t0, delta, data."""
    order = Window.partitionBy("sid", "delta").orderBy("t0")
    micros = F.unix_micros(F.col("t0").cast("timestamp"))
    expected = F.lag(micros + F.size("data") * F.col("delta") * 1e6).over(order)
    new = F.coalesce(F.abs(micros - expected) > F.greatest(tolerance * F.col("delta") * 1e6, F.lit(1.0)), F.lit(True))
    numbered = records.withColumn("_new", new.cast("int")).withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("sid", "delta", "_k").agg(F.min("t0").alias("t0"), F.array_sort(F.collect_list(F.struct("t0", "data"))).alias("d"))
    return joined.select("sid", "t0", "delta", F.flatten(F.transform("d", lambda x: x["data"])).alias("data"))


def build_record(sid: str, t0: datetime, delta: float, values: np.ndarray, encoding: int = STEIM2, length: int = 512, number: int = 1) -> tuple[bytes, int]:
    """One record with as many samples as fit, and their number."""
    network, station, location, channel = sid.split(".")
    if encoding in PLAIN:
        kind = np.dtype(">" + PLAIN[encoding])
        n = min(len(values), (length - 64) // kind.itemsize)
        payload = np.asarray(values[:n]).astype(kind).tobytes()
    else:
        payload, n = encode_steim(values, (length - 64) // 64, encoding)
    rate = 1 / delta
    factor, multiplier = (round(rate), 1) if abs(rate - round(rate)) < 1e-9 and rate >= 1 else (-round(delta), 1) if abs(delta - round(delta)) < 1e-9 else (round(rate * 1000), -1000)
    head = f"{number:06d}D ".encode() + station.ljust(5).encode() + location.ljust(2).encode() + channel.ljust(3).encode() + network.ljust(2).encode()
    head += struct.pack(">HHBBBBHHhh", t0.year, t0.timetuple().tm_yday, t0.hour, t0.minute, t0.second, 0, t0.microsecond // 100, n, factor, multiplier)
    head += struct.pack(">BBBBiHH", 0, 0, 0, 1, 0, 64, 48) + struct.pack(">HHBBBB", 1000, 0, encoding, 1, length.bit_length() - 1, 0)
    return (head.ljust(64, b"\0") + payload).ljust(length, b"\0"), n


def to_bytes(sid: str, t0: datetime, delta: float, values: np.ndarray, encoding: int = STEIM2, length: int = 512) -> bytes:
    """A whole series as records."""
    out, at, number = b"", 0, 1
    while at < len(values):
        record, n = build_record(sid, t0 + timedelta(seconds=at * delta), delta, values[at:], encoding, length, number)
        out, at, number = out + record, at + n, number + 1
    return out


def encode(records: DataFrame, encoding: int = STEIM2, length: int = 512) -> DataFrame:
    """sid, t0, content: each record of the frame as bytes of the format, for any binary sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [to_bytes(r["sid"], r["t0"], r["delta"], np.array(r["data"]), encoding, length) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["sid", "t0", "content"])

    return records.select("sid", "t0", "delta", "data").mapInArrow(run, "sid string, t0 timestamp_ntz, content binary")
