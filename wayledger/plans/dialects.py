"""How databases spell identifiers, literals, types and paging."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import types as T

_COMMON = {T.BooleanType: "BOOLEAN", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "REAL", T.DoubleType: "DOUBLE PRECISION", T.StringType: "VARCHAR", T.TimestampType: "TIMESTAMP", T.BinaryType: "BLOB"}


@dataclass(frozen=True)
class Dialect:
    name: str
    quotes: str = '""'
    types: dict = field(default_factory=dict)
    functions: dict = field(default_factory=dict)
    hex_literal: str = "X'{}'"
    param: str = "${}"
    booleans: tuple[str, str] = ("FALSE", "TRUE")
    paging: str = "LIMIT {limit} OFFSET {offset}"
    multi_row_insert: bool = True
    max_params: int = 999
    truncate: str = "TRUNCATE TABLE {}"

    def quote(self, name: str) -> str:
        left, right = self.quotes
        return left + name.replace(right, right * 2) + right

    def identifier(self, parts: tuple[str, ...] | str) -> str:
        """Quoted at the dots."""
        return ".".join(map(self.quote, parts.split(".") if isinstance(parts, str) else parts))

    def literal(self, value: Any) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return self.booleans[value]
        if isinstance(value, (int, float)):
            return repr(value)
        if isinstance(value, bytes):
            return self.hex_literal.format(value.hex().upper())
        if isinstance(value, datetime):
            return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
        return "'" + str(value).replace("'", "''") + "'"

    def parameter(self, number: int) -> str:
        return self.param.format(number)

    def type_name(self, t: T.DataType, width: int = 0) -> str:
        name = self.types.get(type(t)) or _COMMON[type(t)]
        return f"{name}({width})" if width and isinstance(t, T.StringType) and "(" not in name else name

    def function(self, name: str) -> str:
        return self.functions.get(name.lower(), name.upper())

    def limit(self, sql: str, limit: int, offset: int = 0, order: str | None = None) -> str:
        """A page of ``sql``; without an order a page means nothing."""
        if not order:
            raise ValueError("paging needs an order")
        return f"{sql} ORDER BY {self.identifier(order)} {self.paging.format(limit=limit, offset=offset)}"

    def insert(self, table: str, fields: list[str], rows: int = 1) -> str:
        one = len(fields)
        values = ", ".join("(" + ", ".join(self.parameter(r * one + i + 1) for i in range(one)) + ")" for r in range(rows))
        return f"INSERT INTO {self.identifier(table)} ({', '.join(map(self.quote, fields))}) VALUES {values}"

    def upsert(self, table: str, key: list[str], fields: list[str]) -> str:
        if missing := [k for k in key if k not in fields]:
            raise ValueError(f"the key fields {missing} are not among the fields")
        rest = [f for f in fields if f not in key]
        action = "DO UPDATE SET " + ", ".join(f"{self.quote(f)} = EXCLUDED.{self.quote(f)}" for f in rest) if rest else "DO NOTHING"
        return f"{self.insert(table, fields)} ON CONFLICT ({', '.join(map(self.quote, key))}) {action}"


DIALECTS = {
    d.name: d
    for d in (
        Dialect("spark", "``", {T.StringType: "STRING", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.IntegerType: "INT", T.BinaryType: "BINARY"}, {"len": "LENGTH", "mid": "SUBSTRING", "now": "CURRENT_TIMESTAMP"}, param=":p{}"),
        Dialect("duckdb", types={T.DoubleType: "DOUBLE"}, functions={"len": "LENGTH", "mid": "SUBSTRING"}, hex_literal="'\\x{}'::BLOB", truncate="DELETE FROM {}"),
        Dialect("postgres", types={T.BinaryType: "BYTEA", T.TimestampType: "TIMESTAMP"}, functions={"len": "LENGTH", "mid": "SUBSTRING"}, hex_literal="'\\x{}'", max_params=65535, truncate="TRUNCATE TABLE {} RESTART IDENTITY"),
        Dialect("sqlite", types={T.StringType: "TEXT", T.DoubleType: "REAL", T.LongType: "INTEGER", T.ShortType: "INTEGER", T.TimestampType: "DATETIME"}, functions={"len": "LENGTH", "mid": "SUBSTR"}, param="?{}", booleans=("0", "1"), truncate="DELETE FROM {}"),
        Dialect("mssql", "[]", {T.BooleanType: "BIT", T.StringType: "NVARCHAR", T.DoubleType: "FLOAT", T.BinaryType: "VARBINARY(MAX)", T.TimestampType: "DATETIME2"}, {"mid": "SUBSTRING", "now": "GETDATE"}, "0x{}", "@p{}", ("0", "1"), "OFFSET {offset} ROWS FETCH NEXT {limit} ROWS ONLY", max_params=2100),
        Dialect("hana", types={T.StringType: "NVARCHAR", T.DoubleType: "DOUBLE"}, functions={"len": "LENGTH", "mid": "SUBSTRING", "now": "CURRENT_TIMESTAMP"}, param=":{}", multi_row_insert=False),
    )
}


def rewrite_parameters(sql: str, dialect: str = "spark") -> str:
    """``$n`` markers in the spelling of a dialect; quoted text, quoted and bracketed names stay."""
    d = DIALECTS[dialect]
    return re.sub(r"""('(?:[^']|'')*'|"(?:[^"]|"")*"|\[[^\]]*\])|\$(\d+)""", lambda m: m.group(1) or d.parameter(int(m.group(2))), sql)


def connection(text: str | dict) -> dict[str, Any]:
    """Parts of 'driver:host:port:database:user:password[:(certificates)]', of a path that ends
    in .sqlite, or of a dictionary with the same names."""
    names = ("driver", "host", "port", "database", "user", "password")
    if isinstance(text, dict):
        return {n: text.get(n) for n in (*names, "certificates")}
    if text.endswith(".sqlite"):
        return {"driver": "sqlite3", "host": None, "port": None, "database": text, "user": None, "password": None, "certificates": None}
    certificates = None
    if m := re.search(r":\(([^)]*)\)$", text):
        certificates, text = m.group(1).split(","), text[: m.start()]
    parts = text.split(":")
    if len(parts) != len(names):
        raise ValueError(f"a connection has {len(names)} parts, not {len(parts)}")
    found = dict(zip(names, (p or None for p in parts)))
    return found | {"port": found["port"] and int(found["port"]), "certificates": certificates}


def jdbc_options(c: dict[str, Any]) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``."""
    host = f"{c['host']}:{c['port']}" if c["port"] else c["host"]
    url = {"postgres": f"jdbc:postgresql://{host}/{c['database']}", "sqlite3": f"jdbc:sqlite:{c['database']}", "mssql": f"jdbc:sqlserver://{host};databaseName={c['database']}", "hana": f"jdbc:sap://{host}/?databaseName={c['database']}"}
    if c["driver"] not in url:
        raise ValueError(f"no driver {c['driver']!r}")
    return {"url": url[c["driver"]], "fetchsize": "10000", "batchsize": "5000"} | {k: str(c[k]) for k in ("user", "password") if c[k]}
