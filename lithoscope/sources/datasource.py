"""Waveforms as a data source of Spark: ``spark.read.format("waveform").load(path)`` and ``df.write.format("waveform")``.

Rows: sid, t0, delta, data, encoding.  Register it first: ``spark.dataSource.register(WaveformSource)``.

A MiniSEED file is cut into byte ranges, so that one large file is many tasks.
Records start at multiples of 128 bytes; a task looks for the first header in its
range that is followed by another one (or by the end), and reads every record that
starts in the range, the last one beyond it where it ends there.  A TDMS file is cut
into ranges too, of samples (``tdms``).  SAC and DYNA files are one record and one
task each.

Options: ``waveform`` (mseed, sac, dyna, tdms; by the extension of each file if not
given), ``split`` (bytes of a range), and for writing ``waveform`` (mseed),
``encoding`` and ``length``.  Paths are files, folders or patterns on any store
that Arrow reads (local, HDFS, object stores).

Defined results: files of other extensions are passed over, unless ``waveform`` is
given; empty files have no rows; bytes without headers raise an error, as does a
folder without files.  Writing: MiniSEED gives a file a task, the other formats a
file a record; files take their names only when all tasks are done, so a task that
runs again leaves nothing behind.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import mseed, tdms, waveforms

#: Extensions by format.
EXTENSIONS = {"mseed": "mseed", "ms": "mseed", "miniseed": "mseed", "msd": "mseed", "sac": "sac", "asc": "dyna", "dyna": "dyna", "tdms": "tdms"}
RANGED = ("mseed", "tdms")
SPLIT, STEP, LONGEST = 32 << 20, 128, 1 << 20
_HEAD = re.compile(rb"[0-9 \x00]{6}[DRQM][ \x00]")
_FIELDS = pa.schema([("sid", pa.string()), ("t0", pa.timestamp("us")), ("delta", pa.float64()), ("data", pa.list_(pa.float64())), ("encoding", pa.int32())])


def format_of(path: str, given: str | None = None) -> str | None:
    """A file's format: the given one, else that of its extension."""
    if given and given.lower() not in EXTENSIONS.values():
        raise ValueError(f"{given} is no format of waveforms: mseed, sac, dyna, tdms")
    return given.lower() if given else EXTENSIONS.get(path.rpartition(".")[2].lower())


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    """Files and their sizes: of a file, a folder (and what lies below), or a pattern."""
    store, inner = _store(path)
    fixed = re.split(r"[*?\[]", inner)[0]
    root = inner if fixed == inner else fixed.rpartition("/")[0] or "/"
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type != fs.FileType.NotFound else []
    files = [(f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
    return sorted(f for f in files if fixed == inner or fnmatch.fnmatch(f[0], inner))


@dataclass
class Range(InputPartition):
    path: str
    kind: str
    begin: int
    end: int
    size: int


def record_length(data: bytes, at: int) -> int | None:
    """Bytes of the MiniSEED record at a place, None where there is no header."""
    if len(data) < at + 48 or not _HEAD.match(data, at):
        return None
    order = "big" if 1900 <= int.from_bytes(data[at + 20 : at + 22], "big") <= 2100 else "little"
    number = lambda k: int.from_bytes(data[k : k + 2], order)
    if not (1900 <= number(at + 20) <= 2100 and 1 <= number(at + 22) <= 366):
        return None
    blockette = number(at + 46)
    for _ in range(16):
        if not blockette or at + blockette + 8 > len(data):
            return 512
        if number(at + blockette) == 1000:
            return 1 << data[at + blockette + 6]
        blockette = number(at + blockette + 2)
    return None


def first_record(data: bytes, last: bool) -> int | None:
    """Where the first record begins; what looks like a header counts if the bytes it claims end at another one (or, with ``last``, at the end)."""
    for at in range(0, len(data), STEP):
        length = record_length(data, at)
        if length and (record_length(data, at + length) or (last and at + length >= len(data))):
            return at
    return None


class WaveformReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.given, self.split = options["path"], options.get("waveform"), int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        files = [(path, size, format_of(path, self.given)) for path, size in _listed(self.path)]
        if not files:
            raise FileNotFoundError(self.path)
        step = max(self.split // STEP, 1) * STEP
        return [Range(path, kind, a, min(a + step, size) if kind in RANGED else size, size) for path, size, kind in files if kind for a in range(0, size, step if kind in RANGED else size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as f:
            if partition.kind == "mseed":
                rows = self._records(f, partition)
            elif partition.kind == "tdms":
                rows = tdms.rows(f.read_at, partition.size, partition.begin, partition.end)
            else:
                content = f.read_at(partition.size, 0)
                rows = iter([(waveforms.parse_sac(content) if partition.kind == "sac" else waveforms.parse_dyna(content.decode("latin-1"))) | {"encoding": None}])
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([row[n.name]], n.type) for n in _FIELDS], schema=_FIELDS)

    @staticmethod
    def _records(f: pa.NativeFile, own: Range) -> Iterator[dict]:
        data = f.read_at(min(own.size, own.end + 2 * LONGEST) - own.begin, own.begin)
        at = first_record(data[: own.end - own.begin + 2 * LONGEST], own.end + 2 * LONGEST >= own.size)
        if at is None and own.begin == 0:
            raise ValueError(f"{own.path}: no record found")
        while at is not None and at < own.end - own.begin:
            length = record_length(data, at)
            if length is None:
                if data[at:].strip(b"\0 "):
                    raise ValueError(f"{own.path}: no record at {own.begin + at}")
                return
            yield from mseed.parse_records(data[at : at + length])
            at += length


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class WaveformWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.kind = options["path"], format_of("", options.get("waveform", "mseed"))
        if self.kind == "tdms":
            raise ValueError("TDMS files are only read")
        self.encoding, self.length, self.overwrite = int(options.get("encoding", mseed.STEIM2)), int(options.get("length", 512)), overwrite

    def _put(self, name: str, content: list[bytes]) -> tuple[str, str]:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        hidden = f"{root}/_{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            for part in content:
                out.write(part)
        return hidden, f"{root}/{name}"

    def write(self, iterator: Iterator) -> Written:
        series = ((r.sid, r.t0, r.delta, np.array(r.data or (), float)) for r in iterator)
        if self.kind == "mseed":
            content = [mseed.to_bytes(*row, self.encoding, self.length) for row in series]
            return Written([self._put(f"part-{uuid.uuid4().hex}.mseed", content)] if content else [])
        build = waveforms.build_sac if self.kind == "sac" else waveforms.build_dyna
        named = lambda sid, t0: f"{sid}.{t0:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}.{self.kind}"
        return Written([self._put(named(*row[:2]), [build(*row)]) for row in series])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if self.overwrite:
            for path, _ in _listed(self.path):
                store.delete_file(path)
        elif _listed(self.path):
            self.abort(messages)
            raise FileExistsError(root)
        for message in messages:
            for hidden, final in message.names if message else ():
                store.move(hidden, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for message in messages:
            for hidden, _ in message.names if message else ():
                store.delete_file(hidden)


class WaveformSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "waveform"

    def schema(self) -> str:
        return mseed.SCHEMA

    def reader(self, schema) -> WaveformReader:
        return WaveformReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WaveformWriter:
        return WaveformWriter(dict(self.options), overwrite)

