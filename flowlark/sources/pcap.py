"""pcap files as a Spark data source: batch and streaming reads, writes with rotation.

spark.dataSource.register(PcapSource); then spark.read.format("pcap").load(path)
or spark.readStream.format("pcap").load(folder), and df.write.format("pcap").
A file of more than splitMb (256) is several tasks' work. Paths are those that
driver and workers can open; files in other stores are read with
spark.read.format("binaryFile") and records().
"""

from __future__ import annotations

import glob
import mmap
import os
import re
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format.
HEADER = struct.Struct("<IHHiIII")
RECORD = struct.Struct("<IIII")
MICROS, NANOS = 0xA1B2C3D4, 0xA1B23C4D

SCHEMA = "file string, id long, ts_us long, wire_len long, cap_len int, link_type int, data binary"


def _header(f, name: str) -> tuple[struct.Struct, bool, int]:
    """Of a file at its start: the record header's format, whether fractions are nanoseconds, and the link type."""
    head = f.read(24)
    if len(head) < 24:
        raise ValueError(f"{name}: not a pcap file")
    for order in "<>":
        magic = struct.unpack(order + "I", head[:4])[0]
        if magic in (MICROS, NANOS):
            return struct.Struct(order + "IIII"), magic == NANOS, struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
    raise ValueError(f"{name}: not a pcap file")


def read_pcap(raw, name: str = "", start: int = 0, until: int | None = None, before: int = 0):
    """(file, id, ts_us, wire_len, cap_len, link_type, data) of each whole record; ids count from 1. Both byte orders, micro- and nanoseconds.

    raw is bytes or a binary file; a record cut off by the end of the file ends
    the capture. start and until are the offsets of a split (see splits()), which
    has so many records before it.
    """
    import io

    f = io.BytesIO(raw) if isinstance(raw, bytes | bytearray) else raw
    rec, nano, link = _header(f, name)
    at, n = 24, before
    if start > at:
        f.seek(start)
        at = start
    while (until is None or at < until) and len(h := f.read(16)) == 16:
        sec, frac, size, wire = rec.unpack(h)
        data = f.read(size)
        if len(data) < size:
            return
        at += 16 + size
        n += 1
        yield name, n, sec * 1_000_000 + (frac // 1000 if nano else frac), wire, size, link, data


#: Bytes of a large file that one task reads.
SPLIT_BYTES = 256 << 20


def splits(path: str, size: int = SPLIT_BYTES) -> list[tuple[int, int | None, int]]:
    """(start, until, records before) of parts of a file of about size bytes, cut between records.

    Records have no marks to find them by, so the cuts come from a walk over the
    record headers, a seek each and no data. Files up to size are not opened.
    """
    total = os.path.getsize(path)
    if total <= size:
        return [(0, None, 0)]
    cuts, n = [(24, 0)], 0
    with open(path, "rb") as f:
        rec, _, _ = _header(f, path)
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
            at = 24
            while at + 16 <= total:
                if at - cuts[-1][0] >= size:
                    cuts.append((at, n))
                at += 16 + rec.unpack_from(m, at)[2]
                n += 1
    return [(a, b, k) for (a, k), b in zip(cuts, [c[0] for c in cuts[1:]] + [None], strict=True)]


def pcap_bytes(rows, link_type: int = 1, snaplen: int = 65_535) -> bytes:
    """A little-endian microsecond file of (ts_us, wire_len, data) rows."""
    out = [HEADER.pack(MICROS, 2, 4, 0, 0, snaplen, link_type)]
    for ts, wire, data in rows:
        out += [RECORD.pack(ts // 1_000_000, ts % 1_000_000, len(data), wire), data]
    return b"".join(out)


def records(files: DataFrame) -> DataFrame:
    """Frames of files read as binaryFile (path, content)."""

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for r in read_pcap(raw, path):
                    rows.append(r)
                    if len(rows) == 5000:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


@dataclass
class _File(InputPartition):
    path: str
    start: int = 0
    until: int | None = None
    before: int = 0


def _files(path: str) -> list[str]:
    path = re.sub(r"^file:(//)?", "", path)
    return sorted(p for p in (glob.glob(f"{path}/*") if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))


def _read(p: _File):
    with open(p.path, "rb") as f:
        yield from read_pcap(f, p.path, p.start, p.until, p.before)


def _parts(paths: list[str], options) -> list[_File]:
    size = int(float(options.get("splitMb", SPLIT_BYTES >> 20)) * (1 << 20))
    return [_File(p, *part) for p in paths for part in splits(p, size)]


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.options = options["path"], options

    def partitions(self):
        found = _files(self.path)
        if not found:
            raise FileNotFoundError(self.path)
        return _parts(found, self.options)

    def read(self, partition):
        return _read(partition)


class _StreamReader(DataSourceStreamReader):
    """Files of a growing folder, in name order; the offset is the last name taken. A file must be whole when it appears."""

    def __init__(self, options) -> None:
        self.path, self.options = options["path"], options

    def initialOffset(self):
        return {"last": ""}

    def latestOffset(self):
        found = _files(self.path)
        return {"last": found[-1] if found else ""}

    def partitions(self, start, end):
        return _parts([p for p in _files(self.path) if start["last"] < p <= end["last"]], self.options)

    def read(self, partition):
        return _read(partition)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class Rotation:
    """Numbered segments: a new one before the record that follows once the limit is reached; numbers go on after existing ones, the newest keep stay."""

    def __init__(self, path: str, link_type: int, limit: int, keep: int) -> None:
        self.stem, self.ext = os.path.splitext(path)
        self.link, self.limit, self.keep = link_type, limit, keep
        self.ext = self.ext or ".pcap"
        self.file, self.size = None, 0
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)

    def existing(self) -> list[tuple[int, str]]:
        at = re.compile(re.escape(os.path.basename(self.stem)) + r"\.(\d{6})" + re.escape(self.ext) + r"\Z")
        folder = os.path.dirname(os.path.abspath(self.stem))
        return sorted((int(m[1]), os.path.join(folder, f)) for f in os.listdir(folder) if (m := at.match(f)))

    def open(self) -> None:
        found = self.existing()
        n = found[-1][0] + 1 if found else 1
        self.file = open(f"{self.stem}.{n:06d}{self.ext}", "wb")  # noqa: SIM115
        self.file.write(HEADER.pack(MICROS, 2, 4, 0, 0, 65_535, self.link))
        self.size = HEADER.size
        for _, old in self.existing()[: -self.keep]:
            os.remove(old)

    def write(self, ts: int, wire: int, data: bytes) -> None:
        if self.file is None or self.size >= self.limit:
            self.close()
            self.open()
        self.file.write(RECORD.pack(ts // 1_000_000, ts % 1_000_000, len(data), wire) + data)
        self.size += RECORD.size + len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class _Writer(DataSourceWriter):
    """One file per task (part-NNNNN.pcap), or with rotateMb and keep one rotated series, for which the data has to be one partition."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path = re.sub(r"^file:(//)?", "", options["path"])
        self.link = int(options.get("linkType", "1"))
        self.rotate, self.keep = options.get("rotateMb"), options.get("keep")
        if (self.rotate is None) != (self.keep is None):
            raise ValueError("rotateMb and keep go together")
        self.overwrite = overwrite

    def write(self, rows):
        from pyspark import TaskContext

        if self.rotate is not None:
            if TaskContext.get().partitionId():
                raise ValueError("a rotated series is one file after another: coalesce(1) first")
            out = Rotation(self.path, self.link, int(float(self.rotate) * (1 << 20)), int(self.keep))
            for r in rows:
                out.write(r["ts_us"], r["wire_len"], bytes(r["data"]))
            out.close()
            return _Written([])
        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        name = f"{self.path}/.part-{task.partitionId():05d}-{task.taskAttemptId()}.pcap"
        with open(name, "wb") as f:
            f.write(HEADER.pack(MICROS, 2, 4, 0, 0, 65_535, self.link))
            for r in rows:
                f.write(RECORD.pack(r["ts_us"] // 1_000_000, r["ts_us"] % 1_000_000, len(r["data"]), r["wire_len"]) + bytes(r["data"]))
        return _Written([name])

    def commit(self, messages):
        if self.rotate is not None:
            return
        if self.overwrite:
            for old in _files(self.path):
                os.remove(old)
        for m in messages:
            for f in m.files if m else []:
                os.rename(f, re.sub(r"/\.(part-\d+)-(\d+)\.pcap$", r"/\1-\2.pcap", f))

    def abort(self, messages):
        for m in messages:
            for f in m.files if m else []:
                if os.path.exists(f):
                    os.remove(f)


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)
