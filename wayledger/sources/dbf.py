"""dBase tables as a data source: read in ranges of records, written one file a partition."""

from __future__ import annotations

import datetime as dt
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RECORDS = 100_000  # records in one partition
_JULIAN_EPOCH = 2440588  # day number of 1970-01-01


@dataclass
class DbfField:
    name: str
    kind: str
    width: int
    decimals: int
    offset: int

    def type(self) -> T.DataType:
        if self.kind in "NF":
            return T.DoubleType() if self.decimals or self.kind == "F" else T.LongType() if self.width >= 10 else T.IntegerType()
        return {"C": T.StringType(), "L": T.BooleanType(), "D": T.DateType(), "T": T.TimestampNTZType(), "@": T.TimestampNTZType(), "I": T.IntegerType(), "+": T.IntegerType(), "B": T.DoubleType(), "O": T.DoubleType()}.get(self.kind, T.StringType())

    def value(self, raw: bytes):
        if self.kind in "I+":
            return struct.unpack("<i", raw)[0]
        if self.kind in "BO" and len(raw) == 8:
            return struct.unpack("<d", raw)[0]
        if self.kind in "T@" and len(raw) == 8:
            day, ms = struct.unpack("<ii", raw)
            return dt.datetime(1970, 1, 1) + dt.timedelta(days=day - _JULIAN_EPOCH, milliseconds=ms) if day else None
        text = raw.decode("latin-1").rstrip(" \x00")
        if self.kind == "C":
            return text if text else None
        text = text.strip()
        if not text or text.startswith("*"):
            return None
        if self.kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        try:
            if self.kind == "D":
                return dt.datetime.strptime(text, "%Y%m%d").date()
            if self.kind in "NF":
                return float(text) if isinstance(self.type(), T.DoubleType) else int(float(text))
        except ValueError:
            return None
        return text


@dataclass
class DbfHeader:
    records: int
    start: int
    size: int
    fields: list[DbfField]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type()) for f in self.fields])


def read_header(path: str) -> DbfHeader:
    with open(path, "rb") as f:
        head = f.read(32)
        records, start, size = struct.unpack_from("<IHH", head, 4)
        fields, offset = [], 1
        while (d := f.read(32)) and d[0] != 0x0D and len(d) == 32:
            name = d[:11].split(b"\0")[0].decode("latin-1")
            field = DbfField(name, chr(d[11]), d[16], d[17], offset)
            fields.append(field)
            offset += field.width
    return DbfHeader(records, start, size, fields)


def read_records(path: str, header: DbfHeader, first: int, last: int, erased: bool = False) -> Iterator[tuple]:
    """Values of records ``first`` to ``last``; erased ones are skipped, or come as None."""
    with open(path, "rb") as f:
        f.seek(header.start + first * header.size)
        for _ in range(first, last):
            record = f.read(header.size)
            if len(record) < header.size:
                return
            if record[:1] == b"*":
                if erased:
                    yield None
                continue
            yield tuple(x.value(record[x.offset : x.offset + x.width]) for x in header.fields)


def local_path(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def tables(path: str) -> list[str]:
    """The tables of a folder, or the one a path names."""
    return sorted(f"{path}/{n}" for n in os.listdir(path) if n.lower().endswith(".dbf")) if os.path.isdir(path) else [path]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


class DbfSource(DataSource):
    """``spark.read.format('dbf').load(path)``; the file must be on a path every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> T.StructType:
        found = tables(local_path(self.options["path"]))
        return read_header(found[0]).schema() if found else T.StructType()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DbfReader(local_path(self.options["path"]), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return DbfWriter(local_path(self.options["path"]), schema)


class DbfReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.names = path, schema.fieldNames()

    def partitions(self) -> list[Range]:
        sizes = {p: read_header(p).records for p in tables(self.path)}
        return [Range(p, i, min(n, i + RECORDS)) for p, n in sizes.items() for i in range(0, max(n, 1), RECORDS)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        header = read_header(partition.path)
        at = [[f.name for f in header.fields].index(n) for n in self.names]
        for row in read_records(partition.path, header, partition.first, partition.last):
            yield tuple(row[i] for i in at)


def _layout(field: T.StructField) -> tuple[str, int, int]:
    if isinstance(field.dataType, T.BooleanType):
        return "L", 1, 0
    if isinstance(field.dataType, (T.ShortType, T.IntegerType)):
        return "N", 9, 0
    if isinstance(field.dataType, T.LongType):
        return "N", 18, 0
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return "N", 20, 8
    if isinstance(field.dataType, T.DateType):
        return "D", 8, 0
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return "T", 8, 0
    return "C", 254, 0


def _cell(kind: str, width: int, decimals: int, value) -> bytes:
    if kind == "T":
        if value is None:
            return bytes(8)
        since = value - dt.datetime(1970, 1, 1)
        return struct.pack("<ii", since.days + _JULIAN_EPOCH, since.seconds * 1000 + since.microseconds // 1000)
    if value is None:
        return b" " * width
    text = {"L": lambda: "T" if value else "F", "D": lambda: f"{value:%Y%m%d}", "N": lambda: f"{value:.{decimals}f}".rjust(width)}.get(kind, lambda: str(value))()
    raw = text.encode("latin-1", "replace")
    if len(raw) > width and kind != "C":
        raise ValueError(f"{text!r} is wider than {width}")
    return raw[:width].ljust(width)


def write_dbf(path: str, schema: T.StructType, rows: Iterator) -> int:
    layout = [(f.name, *_layout(f)) for f in schema]
    size = 1 + sum(w for _, _, w, _ in layout)
    start = 32 + 32 * len(layout) + 1
    n = 0
    with open(path, "wb") as f:
        f.write(bytes(start))
        for row in rows:
            f.write(b" " + b"".join(_cell(k, w, d, v) for (_, k, w, d), v in zip(layout, row)))
            n += 1
        f.write(b"\x1a")
        f.seek(0)
        f.write(struct.pack("<BBBBIHH20x", 0x30 if any(x[1] == "T" for x in layout) else 3, 124, 1, 1, n, start, size))
        for name, kind, width, decimals in layout:
            f.write(struct.pack("<11sc4xBB14x", name.encode("latin-1", "replace")[:10], kind.encode(), width, decimals))
        f.write(b"\x0d")
    return n


class DbfWriter(DataSourceWriter):
    """A folder with one table per partition; a failed write leaves none of its files."""

    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.table = path, schema

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        name = f"{self.path}/part-{context.partitionId():05d}-{context.taskAttemptId()}.dbf"
        write_dbf(name + ".draft", self.table, rows)
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages) -> None:
        for m in filter(None, messages):
            os.replace(m.name + ".draft", m.name)

    def abort(self, messages) -> None:
        for m in filter(None, messages):
            os.unlink(m.name + ".draft")
