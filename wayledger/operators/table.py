"""Relational operators on DataFrames: semi joins, multi-key sorts, edits by position, schema edits.

Positions are given by an explicit order, for a distributed table has none of its own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.runtime import stage


class TableError(ValueError):
    """A field that is missing, ambiguous or of the wrong shape."""


def resolve(df: DataFrame, name: str) -> str | None:
    """The field called ``name``: exactly, else the first one without regard to case."""
    if name in df.columns:
        return name
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def _field(df: DataFrame, name: str) -> str:
    found = resolve(df, name)
    if found is None:
        raise TableError(f"no field {name!r}")
    return found


def unique_fields(df: DataFrame) -> DataFrame:
    """The first column of each name; later ones of the same name drop out."""
    seen: set[str] = set()
    keep = [i for i, c in enumerate(df.columns) if not (c in seen or seen.add(c))]
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in keep])


def store(df: DataFrame, types: dict[str, T.DataType] | None = None) -> DataFrame:
    """A result as a table: names made unique, the given fields cast (values that cannot be become null)."""
    df = unique_fields(df)
    types = types or {}
    return df.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def project(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """The named fields, found without regard to case, under the names asked for."""
    return df.select(*[F.col(f"`{_field(df, f)}`").alias(f) for f in fields])


def semi_filter(df: DataFrame, field: str, foreign: DataFrame, foreign_field: str) -> DataFrame:
    """Rows whose ``field`` occurs in ``foreign``; null keys match nothing, repeated rows stay.

    A left semi join never multiplies rows, so filters over several tables chain without growth.
    """
    keys = foreign.select(F.col(f"`{_field(foreign, foreign_field)}`").alias("_key"))
    return df.join(keys, df[f"`{_field(df, field)}`"] == keys["_key"], "left_semi")


def sort_by(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Ascending by the named fields, nulls first, text by bytes."""
    return df.orderBy(*[F.col(f"`{_field(df, f)}`").asc_nulls_first() for f in fields])


def with_position(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Position of each row, from 0, in the order of the given fields, ties in the order of a hash of the row.

    The hash also cuts a hot value of the order into several ranges. No single task sorts or numbers the whole table: rows are range-partitioned by the order, the
    partitions' sizes are summed on the driver, and positions are counted within each partition.
    """
    hashable = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [*[F.col(f"`{_field(df, f)}`").asc_nulls_first() for f in order], F.xxhash64(*hashable)]
    parts = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "positions")
    sizes = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}  # one row a partition
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __start bigint"))
    within = W.partitionBy("__part").orderBy(*keys)
    numbered = parts.withColumn("__row", F.row_number().over(within)).join(begin, "__part")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + F.col("__row") - 1).alias(name))


def erase_rows(df: DataFrame, order: list[str], positions: Iterable[int]) -> DataFrame:
    """Without the rows at the given positions."""
    gone = sorted(set(positions))
    return with_position(df, order, "_at").where(~F.col("_at").isin(gone) if gone else F.lit(True)).drop("_at")


def set_cell(df: DataFrame, order: list[str], position: int, field: str, value) -> DataFrame:
    """With one cell changed."""
    name = _field(df, field)
    changed = F.when(F.col("_at") == position, F.lit(value).cast(df.schema[name].dataType)).otherwise(F.col(f"`{name}`"))
    return with_position(df, order, "_at").withColumn(name, changed).drop("_at")


def add_field(df: DataFrame, name: str, t: T.DataType | str) -> DataFrame:
    """With a new field of nulls."""
    if name in df.columns:
        raise TableError(f"there is a field {name!r}")
    return df.withColumn(name, F.lit(None).cast(t))


def attach(df: DataFrame, order: list[str], other: DataFrame, other_order: list[str], field: str, name: str) -> DataFrame:
    """With ``field`` of ``other`` as a new field, matched by position; null beyond its end."""
    left = with_position(df, order, "_at")
    right = with_position(other.select(*dict.fromkeys([*other_order, field])), other_order, "_at").select("_at", F.col(f"`{field}`").alias(name))
    return left.join(right, "_at", "left").drop("_at")


def rename_field(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise TableError(f"no field {old!r}")
    if new in df.columns and new != old:
        raise TableError(f"there is a field {new!r}")
    return df.withColumnRenamed(old, new)


def delete_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[_field(df, n) for n in names])


def keep_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"`{_field(df, n)}`") for n in names])


def add_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """With more rows; fields they lack become null, fields the table lacks are an error."""
    if extra := [c for c in rows.columns if c not in df.columns]:
        raise TableError(f"no fields {extra}")
    cast = rows.select(*[F.col(f"`{c}`").cast(df.schema[c].dataType).alias(c) for c in rows.columns])
    return df.unionByName(cast, allowMissingColumns=True)


def add_full_row(df: DataFrame, values: list) -> DataFrame:
    if len(values) != len(df.columns):
        raise TableError(f"{len(values)} values for {len(df.columns)} fields")
    return df.union(df.sparkSession.createDataFrame([tuple(values)], df.schema))


def check_columns(columns: dict[str, list]) -> int:
    """The common length of columns that are to be added; none may be all null."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise TableError("the columns differ in length")
    if empty := [n for n, v in columns.items() if all(x is None for x in v)]:
        raise TableError(f"no type for {empty}")
    return lengths.pop() if lengths else 0


def all_null(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """One row: whether each field has no value; true for fields that do not exist."""
    return df.agg(*[(F.count(f"`{resolve(df, f)}`") == 0 if resolve(df, f) else F.lit(True)).alias(f) for f in fields])


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


class Table:
    """A table that may not have been fetched yet: 'no rows' and 'not fetched' differ."""

    def __init__(self, df: DataFrame | None = None) -> None:
        self.df = df

    @property
    def populated(self) -> bool:
        return self.df is not None

    def clear_rows(self) -> Table:
        return Table(self.df and empty_like(self.df))

    def clear(self) -> Table:
        return Table()


_WIDER = [T.BooleanType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def column_type(values: Iterable, default: T.DataType = T.IntegerType()) -> T.DataType:
    """Type of a column by its first value; ``default`` for none."""
    for v in values:
        if v is not None:
            return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}.get(type(v)) or T.TimestampType()
    return default


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both; a null type gives way to any, numbers widen, anything else becomes text."""
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if type(a) in _WIDER and type(b) in _WIDER:
        return max((a, b), key=lambda t: _WIDER.index(type(t)))
    return T.StringType()


def merge_schemas(*frames: DataFrame) -> DataFrame:
    """All rows of all tables; fields by name, types widened, missing fields null."""
    types: dict[str, T.DataType] = {}
    for f in frames:
        for s in f.schema:
            types[s.name] = widened(types[s.name], s.dataType) if s.name in types else s.dataType
    out = None
    for f in frames:
        cast: list[Column] = [F.col(f"`{n}`").cast(t).alias(n) if n in f.columns else F.lit(None).cast(t).alias(n) for n, t in types.items()]
        out = f.select(*cast) if out is None else out.unionByName(f.select(*cast))
    return out
