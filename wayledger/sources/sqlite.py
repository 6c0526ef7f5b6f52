"""SQLite tables as a data source, read in ranges of rowids; and the schema of a SQLite database."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayledger.sources.dbf import local_path

_AFFINITY = [("BOOL", T.BooleanType()), ("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()), ("NUMERIC", T.DoubleType()), ("DATE", T.StringType()), ("TIME", T.StringType())]


def type_of(declared: str) -> T.DataType:
    """Spark's type of a declared column type."""
    return next((t for word, t in _AFFINITY if word in declared.upper()), T.StringType())


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def table_schema(path: str, table: str) -> T.StructType:
    with connect(path) as c:
        rows = c.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not rows:
        raise ValueError(f"no table {table!r}")
    return T.StructType([T.StructField(name, type_of(kind or ""), not required, {"primary_key": bool(key)}) for _, name, kind, required, _, key in rows])


def database_schema(path: str) -> dict[str, dict]:
    """Tables with their fields and indexes."""
    out = {}
    with connect(path) as c:
        for (name,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            indexes = [{"name": i[1], "unique": bool(i[2]), "fields": [f[2] for f in c.execute(f"PRAGMA index_info({quoted(i[1])})")]} for i in c.execute(f"PRAGMA index_list({quoted(name)})").fetchall()]
            out[name] = {"fields": table_schema(path, name), "indexes": indexes}
    return out


def parse_create_table(sql: str) -> tuple[str, list[tuple[str, str]]]:
    """(table, [(field, type)]) of a CREATE TABLE statement, without its table constraints."""
    m = re.match(r'\s*CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?("(?:[^"]|"")+"|\[[^\]]+\]|`[^`]+`|[\w.]+)\s*\((.*)\)', sql, re.IGNORECASE | re.DOTALL)
    if not m:
        raise ValueError("no CREATE TABLE")
    bare = lambda s: s[1:-1] if s[:1] in '"[`' else s
    parts, depth, start = [], 0, 0
    body = m.group(2)
    for i, ch in enumerate(body + ","):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(body[start:i].strip())
            start = i + 1
    fields = []
    for p in parts:
        if re.match(r"(PRIMARY|UNIQUE|CHECK|FOREIGN|CONSTRAINT)\b", p, re.IGNORECASE):
            continue
        f = re.match(r'("(?:[^"]|"")+"|\[[^\]]+\]|`[^`]+`|\w+)\s*((?!PRIMARY|NOT|NULL|UNIQUE|DEFAULT|CHECK|COLLATE|REFERENCES)\w+(?:\s*\([^)]*\))?)?', p, re.IGNORECASE)
        fields.append((bare(f.group(1)), (f.group(2) or "").strip()))
    return bare(m.group(1)), fields


@dataclass
class Rowids(InputPartition):
    first: int
    last: int


class SqliteSource(DataSource):
    """Options: path, dbtable, numPartitions (4). The file must be on a path every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        return table_schema(local_path(self.options["path"]), self.options["dbtable"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(local_path(self.options["path"]), self.options["dbtable"], schema, int(self.options.get("numPartitions", 4)))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, parts: int) -> None:
        self.path, self.table, self.fields, self.parts = path, table, schema, parts

    def partitions(self) -> list[Rowids]:
        with connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Rowids(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Rowids(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rowids) -> Iterator[tuple]:
        names = ", ".join(map(quoted, self.fields.fieldNames()))
        kinds = [f.dataType for f in self.fields]
        with connect(self.path) as c:
            for row in c.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.first, partition.last)):
                yield tuple(self._value(v, t) for v, t in zip(row, kinds))

    @staticmethod
    def _value(v, t: T.DataType):
        """SQLite values have their own types; one that the column's type cannot hold becomes null."""
        if v is None:
            return None
        try:
            if isinstance(t, T.LongType):
                return int(v)
            if isinstance(t, T.DoubleType):
                return float(v)
            if isinstance(t, T.BooleanType):
                return bool(int(v))
            if isinstance(t, T.BinaryType):
                return v if isinstance(v, bytes) else str(v).encode()
            return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
        except (TypeError, ValueError):
            return None
