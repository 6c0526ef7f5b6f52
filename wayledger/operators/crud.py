"""Inserts, upserts, updates and deletes as functions from table to table, and a store that keeps versions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wayledger.runtime import put_new


class RowCountError(ValueError):
    """More than one row where one was asked for."""


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows.select(*[F.col(c).cast(target.schema[c].dataType) for c in target.columns if c in rows.columns]), allowMissingColumns=True)


def insert_one(target: DataFrame, **values) -> DataFrame:
    fields = [f for f in target.schema if f.name in values]
    if len(fields) != len(values):
        raise ValueError(f"no fields {sorted(set(values) - set(target.columns))}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return append(target, target.sparkSession.createDataFrame([tuple(values[f.name] for f in fields)], schema))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in the order; map-side combined, so a hot key costs no more than others."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest) if rest else F.lit(1), rank).alias("_row"))
    return best.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in rows.columns])


def upsert(target: DataFrame, source: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """``source`` rows replace or join the ``target`` rows of the same key.

    Fields that ``source`` lacks keep their value, or are null in new rows. With ``order`` the last source row of
    a key counts; without, keys of ``source`` must be unique, or the query fails when it meets a repeated one.
    """
    if missing := [k for k in key if k not in source.columns]:
        raise ValueError(f"the key fields {missing} are not among the fields")
    return _overwrite(target, source, key, order, "full_outer")


def _overwrite(target: DataFrame, source: DataFrame, key: list[str], order: list[Column] | None, how: str) -> DataFrame:
    if order:
        new = latest(source, key, order)
    else:
        rest = F.struct(*[c for c in source.columns if c not in key] or [F.lit(1).alias("_")])
        one = source.groupBy(*key).agg(F.count("*").alias("_n"), F.first(rest).alias("_row"))
        alone = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit(f"the key {', '.join(key)} is repeated")).cast(one.schema["_row"].dataType))
        new = one.select(*key, alone.alias("_row")).select(*key, *[F.col("_row")[c].alias(c) for c in source.columns if c not in key])
    fields = [c for c in source.columns if c not in key]
    new = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_is_new"))
    joined = target.join(new, key, how)
    pick = [F.col(c) if c in key else F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in fields else F.col(c) for c in target.columns]
    return joined.select(*pick)


def update_by_key(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Source fields overwrite the target's where the key exists; other keys of ``source`` are ignored."""
    return _overwrite(target, source, key, None, "left")


def delete_by_key(target: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return target.join(keys.select(*key), key, "left_anti")


def exists(keys: DataFrame, target: DataFrame, key: str, target_key: str) -> DataFrame:
    """``keys`` with a boolean ``found``; repeated keys stay, null is never found."""
    there = target.select(F.col(target_key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("found", F.lit(True))
    return keys.join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def strings(df: DataFrame, field: str) -> DataFrame:
    return df.select(F.col(field).cast("string").alias(field))


def one_row(df: DataFrame) -> Row | None:
    """The only row; None if there is none, an error if there are more."""
    found = df.take(2)
    if len(found) > 1:
        raise RowCountError("more than one row")
    return found[0] if found else None


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order, which is required."""
    if not order:
        raise ValueError("paging needs an order")
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).offset(offset).limit(limit)


def error_kind(error: Exception) -> str:
    """'table not found', 'field not found', 'syntax', 'type' or 'other'."""
    if not isinstance(error, (AnalysisException, PySparkException)):
        return "other"
    condition = error.getCondition() or ""
    if condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return "table not found"
    if condition.startswith("UNRESOLVED_COLUMN"):
        return "field not found"
    if condition.startswith("PARSE"):
        return "syntax"
    return "type" if condition.startswith(("DATATYPE_MISMATCH", "CAST_")) else "other"


def iterate(df: DataFrame) -> Iterator[Row]:
    """The rows one by one, a partition at a time: the driver never holds more than two partitions. An error ends the iteration where it occurs."""
    yield from df.toLocalIterator(prefetchPartitions=True)


def consume(df: DataFrame, sink: Callable[[Iterator[pa.RecordBatch]], None]) -> int:
    """Hand the rows of each partition to ``sink``, in Arrow batches, where they are; gives their number.

    A partition whose task fails is handed over again from its start, so a sink must bear repetition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal n
            for batch in batches:
                n += batch.num_rows
                yield batch

        sink(counted())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Store:
    """Tables in a folder. A transaction stages new versions; commit names them all in one new file of the log.

    A table may have deltas: rows of some keys that replace those of the table, the last delta first. They are merged when
    the table is read, until ``compact`` writes it whole.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.root}/{name}")
        self._fs = hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        there = self._path(folder)
        return sorted(n for s in self._fs.listStatus(there) if (n := s.getPath().getName())[0] != ".") if self._fs.exists(there) else []

    def _version(self, name: str) -> dict[str, str]:
        stream = self._fs.open(self._path(f"log/{name}"))
        lines = bytes(stream.readAllBytes()).decode().splitlines()
        stream.close()
        return dict(line.split("\t") for line in lines)

    def tables(self) -> dict[str, str]:
        """Folder of the current version of each table and delta."""
        log = self._names("log")
        return self._version(log[-1]) if log else {}

    def deltas(self, table: str) -> list[str]:
        return sorted(n for n in self.tables() if n.startswith(f"{table}@"))

    def read(self, table: str) -> DataFrame:
        folders = self.tables()
        rows = lambda name: self.spark.read.parquet(f"{self.root}/{folders[name]}")
        base, deltas = rows(table), sorted(n for n in folders if n.startswith(f"{table}@"))
        if not deltas:
            return base
        key = deltas[-1].split("@")[2].split(",")
        every = base.withColumn("_batch", F.lit(-1))
        for n, name in enumerate(deltas):
            every = every.unionByName(rows(name).select(*base.columns).withColumn("_batch", F.lit(n)))
        return latest(every, key, [F.col("_batch")]).drop("_batch")

    def begin(self) -> Transaction:
        return Transaction(self)

    def vacuum(self, keep: int = 2) -> None:
        """Remove all versions but the last ``keep``, and the rows that only they have."""
        log = self._names("log")
        kept = log[-keep:]
        named = {folder.rsplit("/", 1)[-1] for n in kept for folder in self._version(n).values()}
        first = min((self._fs.getFileStatus(self._path(f"log/{n}")).getModificationTime() for n in kept), default=0)
        for n in log[:-keep]:
            self._fs.delete(self._path(f"log/{n}"), False)
        for n in self._names("data"):
            # what is younger than the versions kept may belong to a transaction under way
            if n not in named and self._fs.getFileStatus(self._path(f"data/{n}")).getModificationTime() < first:
                self._fs.delete(self._path(f"data/{n}"), True)


class Transaction:
    """Staged versions of tables. Leaving the block by an error, or without commit, drops them."""

    def __init__(self, store: Store) -> None:
        log = store._names("log")
        self.store, self.staged, self.dropped, self.number = store, {}, set(), int(log[-1]) + 1 if log else 0

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *error) -> None:
        self.rollback()

    def read(self, table: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.store.root}/{self.staged[table]}") if table in self.staged else self.store.read(table)

    def write(self, table: str, df: DataFrame) -> None:
        """A new version of the table, instead of what it has, its deltas included."""
        folder = f"data/{re.sub('[^A-Za-z0-9_]', '_', table)}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.store.root}/{folder}")
        self.staged[table] = folder
        self.dropped |= set(self.store.deltas(table))

    def write_delta(self, table: str, number: int, key: list[str], rows: DataFrame) -> None:
        """Rows, one a key, that replace or join those of the table."""
        self.write(f"{table}@{number:012d}@{','.join(key)}", rows)

    def truncate(self, table: str) -> None:
        self.write(table, self.read(table).limit(0))

    def commit(self) -> None:
        s = self.store
        log = s._names("log")
        if log and int(log[-1]) >= self.number:  # its file may be gone already
            raise RuntimeError("another transaction was committed first")
        named = {t: f for t, f in s.tables().items() if t not in self.dropped} | self.staged
        try:
            put_new(s.spark, f"{s.root}/log/{self.number:09d}", "".join(f"{t}\t{f}\n" for t, f in named.items()))
        except FileExistsError as e:
            raise RuntimeError("another transaction was committed first") from e
        self.staged = {}

    def rollback(self) -> None:
        for folder in self.staged.values():
            self.store._fs.delete(self.store._path(folder), True)
        self.staged = {}
