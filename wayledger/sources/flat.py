"""Delimited text with type inference, and the choice of a reader by file extension."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.functions.wkt import geom_from_wkt
from wayledger.operators.table import with_position
from wayledger.sources import dbf, shapefile

SEPARATORS = (",", "\t", ";")
SNIFF_LINES = 10

# bits of what the cells of a column have been seen to be
INTEGER, DOUBLE, POINT, MULTIPOINT, POLYLINE, POLYGON, OTHER = (1 << i for i in range(7))
_WKT = {POINT: "POINT", MULTIPOINT: "MULTIPOINT", POLYLINE: "(MULTI)?LINESTRING", POLYGON: "(MULTI)?POLYGON"}


def sniff_separator(head: str) -> str:
    """The separator that cuts the first lines into equally many columns, the most if several do."""
    tables = {s: [r for r in csv.reader(io.StringIO(head), delimiter=s) if r][:SNIFF_LINES] for s in SEPARATORS}
    even = [s for s, rows in tables.items() if len({len(r) for r in rows}) == 1 and len(rows[0]) > 1]
    # with short rows no separator cuts evenly; then the header decides
    return max(even or [s for s, rows in tables.items() if rows] or [","], key=lambda s: len(tables[s][0]) if tables[s] else 0)


def unique_headers(names: list[str]) -> list[str]:
    """Repeated names with _1, _2, ... behind them."""
    used: set[str] = set()
    out = []
    for name in names:
        new, n = name, 0
        while new in used:
            n += 1
            new = f"{name}_{n}"
        used.add(new)
        out.append(new)
    return out


def cell_mask(c: Column) -> Column:
    """Bit of the kind of value a cell holds; 0 for an empty one."""
    kind = F.when(F.coalesce(c, F.lit("")) == "", 0)
    kind = kind.when(c.rlike(r"^[+-]?\d{1,18}$"), INTEGER).when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), DOUBLE)
    for bit, word in _WKT.items():
        kind = kind.when(c.rlike(rf"(?i)^\s*{word}\s*(ZM|Z|M)?\s*\("), bit)
    return kind.otherwise(OTHER)


def column_masks(df: DataFrame) -> DataFrame:
    """One row: the masks of all columns, over all rows."""
    return df.agg(*[F.coalesce(F.bit_or(cell_mask(F.col(f"`{c}`"))), F.lit(0)).alias(c) for c in df.columns])


def type_of_mask(mask: int) -> str:
    """'bigint', 'double', 'point', ..., 'geometry' or 'string'."""
    if mask == INTEGER:
        return "bigint"
    if mask and not mask & ~(INTEGER | DOUBLE):
        return "double"
    names = {POINT: "point", MULTIPOINT: "multipoint", POLYLINE: "polyline", POLYGON: "polygon"}
    if mask in names:
        return names[mask]
    return "geometry" if mask and not mask & ~sum(names) else "string"


def read_csv(spark: SparkSession, path: str, separator: str | None = None, infer: bool = True) -> DataFrame:
    """Rows of a delimited file with a header.

    Short rows are filled with null, empty cells are null but in text columns, where they stay ''. Quotes are
    doubled inside quotes; lines may end in CR LF. Types are found from all rows in one pass.
    """
    head = "\n".join(r.value for r in spark.read.text(path).limit(SNIFF_LINES + 1).collect())
    separator = separator or sniff_separator(head)
    names = unique_headers(next(csv.reader(io.StringIO(head), delimiter=separator), []))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__short"]])
    cells = spark.read.schema(schema).csv(path, sep=separator, header=True, enforceSchema=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__short")
    # an empty cell is read as null; it is one of a short row only if nothing follows it there
    later = lambda i: F.coalesce(*[F.col(f"`{n}`") for n in names[i + 1 :]], F.lit(None)).isNotNull()
    there = lambda i: F.col("__short").isNull() | later(i)
    raw = cells.select(*[F.when(F.col(f"`{n}`").isNull() & there(i), "").otherwise(F.col(f"`{n}`")).alias(n) for i, n in enumerate(names)])
    if not infer or not names:
        return raw
    masks = column_masks(raw).first().asDict()
    out = []
    for n in names:
        c, kind = F.col(f"`{n}`"), type_of_mask(masks[n])
        empty = F.nullif(F.trim(c), F.lit(""))
        out.append((c if kind == "string" else empty.try_cast(kind) if kind in ("bigint", "double") else geom_from_wkt(empty)).alias(n))
    return raw.select(*out)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """With a header; cells with the separator, quotes or line ends are quoted."""
    df.write.csv(path, sep=separator, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def encode_cell(c: Column) -> Column:
    """A cell in quotes if it holds a comma, a quote or a line end."""
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """A .csv, .dbf or .shp file."""
    extension = re.search(r"\.(\w+)$", path)
    kind = extension.group(1).lower() if extension else ""
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("dbf", "shp"):
        spark.dataSource.register(dbf.DbfSource if kind == "dbf" else shapefile.ShapeSource)
        return spark.read.format(kind).load(path)
    raise ValueError(f"no reader for {path!r}")


def copy_table(df: DataFrame, rename: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """The fields named in ``rename`` (all without it), renamed, with the given types forced."""
    rename, types = rename or {c: c for c in df.columns}, types or {}
    return df.select(*[(F.col(f"`{old}`").try_cast(types[new]) if new in types else F.col(f"`{old}`")).alias(new) for old, new in rename.items()])


def with_row_id(df: DataFrame, order: list[str], name: str = "rowid") -> DataFrame:
    """With a key from 1 in the order of the given fields."""
    return with_position(df, order, name).withColumn(name, F.col(name) + 1)
