"""Processing only new or changed records.

The commit sequence is a number or time that grows with every row that becomes visible. A run reads the watermark of the
last good run, fixes an upper limit when it starts, and handles exactly the rows in [watermark, upper). Its output and
the new watermark become visible in one step: both are named by one manifest file, which is put in place under a
name that may not exist yet.

A row must not become visible below a limit that is committed. Sequences that a database hands out at commit
keep this by themselves. Where writers take their number or time before they commit, name the least one of those in flight
(``in_flight``), or how late a row may come (``delay``); the limit is held below it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.runtime import fits_broadcast, put_new, stage


def _literal(value: datetime | int, kind: T.DataType) -> Column:
    """A value of the commit sequence; times are taken as they read, in the session's zone if the column has zones."""
    return F.lit(value.isoformat(sep=" ") if isinstance(value, datetime) else value).cast(kind)


def _wall(column: Column, kind: T.DataType) -> Column:
    return column.cast("timestamp_ntz") if isinstance(kind, T.TimestampType) else column


def last_good_start(runs: DataFrame) -> datetime | None:
    """Start of the succeeded run that started last; None if no run succeeded.

    Runs of other states, runs without a start and repeated rows change nothing; the order of
    the rows and the finish times do not matter.
    """
    return runs.where(F.col("status") == "succeeded").agg(_wall(F.max("started_at"), runs.schema["started_at"].dataType)).first()[0]


CANDIDATES = 200_000  # records with new rows up to which their keys are broadcast against the rows seen


def changed_records(log: DataFrame, keys: list[str], sequence: str, version: str, since: datetime | int | None, upper: datetime | int | None = None, broadcast: int = CANDIDATES) -> DataFrame:
    """Keys of the records that are new or changed since ``since``, each once.

    ``log`` holds delivered versions of records. Rows with ``sequence`` before ``since`` were
    seen; rows at or after it are new; rows at or after ``upper`` belong to a later run. A record
    comes out if it has new rows and their greatest ``version`` is greater than the greatest
    seen one, or no row was seen. A null version is lower than any other and equal to null.

    A null ``sequence`` counts as new, for it was never proven seen; ``IncrementalJob`` gives such rows a place. Without
    ``since`` every record comes out. A null in ``keys`` is a key value of its own. An empty log gives no rows.
    """
    kind = log.schema[sequence].dataType
    if upper is not None:
        log = log.where(F.col(sequence).isNull() | (F.col(sequence) < _literal(upper, kind)))
    if since is None:
        return log.select(*keys).distinct()
    new = log.where(F.col(sequence).isNull() | (F.col(sequence) >= _literal(since, kind)))
    return newer_records(new, log.where(F.col(sequence) < _literal(since, kind)), keys, version, broadcast)


def newer_records(new: DataFrame, seen: DataFrame, keys: list[str], version: str, broadcast: int = CANDIDATES) -> DataFrame:
    """Keys of ``new`` that ``seen`` lacks or has only with lower versions, each once.

    Only the new rows are shuffled, and of the rows seen those of the same keys: these keys are broadcast, or
    joined if there are more than ``broadcast`` of them. Either side is aggregated map-side first, so a key with
    a third of all rows costs no more than another.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = lambda df: df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(version).alias("version"))
    found = stage(rows(new).groupBy(*names).agg(F.max("version").alias("version")), "new-records")
    held = found.select(*[F.col(n).alias(f"n{i}") for i, n in enumerate(names)])
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"n{i}")) for i, n in enumerate(names)])
    if fits_broadcast(held, broadcast):
        known = rows(seen).join(F.broadcast(held), same, "left_semi").groupBy(*names).agg(F.max("version").alias("version"))
    else:
        known = rows(seen).groupBy(*names).agg(F.max("version").alias("version")).join(held, same, "left_semi")
    folded = found.select(*names, F.col("version").alias("new"), F.lit(None).cast(found.schema["version"].dataType).alias("old"), F.lit(False).alias("was_seen"))
    folded = folded.unionByName(known.select(*names, F.lit(None).cast(found.schema["version"].dataType).alias("new"), F.col("version").alias("old"), F.lit(True).alias("was_seen")))
    folded = folded.groupBy(*names).agg(F.max("new").alias("new"), F.max("old").alias("old"), F.bool_or("was_seen").alias("was_seen"))
    newer = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") > F.col("old")))
    return folded.where(~F.col("was_seen") | newer).select(*[F.col(n).alias(k) for k, n in zip(keys, names)])


@dataclass(frozen=True)
class Batch:
    """What a run is to handle: rows ``new`` in [since, upper), and ``seen``, those before ``since``."""

    new: DataFrame
    seen: DataFrame
    since: datetime | int | None
    upper: datetime | int


class IncrementalJob:
    """Runs a step over the new rows of one or several logs and commits output and watermark together.

    ``root`` is a folder on a shared file system: ``data/<run>`` holds the outputs and
    ``commits/<n>.json`` the manifests, in order. Only outputs that a manifest names exist for
    readers. A run that dies before its commit leaves no trace but files nobody reads (``clean`` removes them); the next
    run starts from the same watermark. Two runs at once race for the same manifest name and
    one of them fails.

    The commit is as atomic and exclusive as ``runtime.put_new``.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def manifests(self) -> list[dict]:
        """The committed runs, oldest first."""
        folder = self._path("commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._read(f"commits/{n}")) for n in names]

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def watermark(self) -> datetime | int | None:
        """The upper limit of the last committed run."""
        done = self.manifests()
        return self._value(done[-1]["upper"]) if done else None

    @staticmethod
    def _value(stored: str | int) -> datetime | int:
        return datetime.fromisoformat(stored) if isinstance(stored, str) else stored

    @staticmethod
    def _text(value: datetime | int | None) -> str | int | None:
        return value.isoformat() if isinstance(value, datetime) else value

    def start_at(self, watermark: datetime | int) -> None:
        """Take over from another scheduler: the first run begins at its watermark. Once there is a run, nothing happens."""
        if not self.manifests():
            self._commit({"run": 0, "since": None, "upper": self._text(watermark), "output": None})

    def run(
        self,
        logs: DataFrame | dict[str, DataFrame],
        sequence: str,
        step: Callable[..., DataFrame],
        upper: datetime | int | None = None,
        in_flight: datetime | int | None = None,
        delay: timedelta | int | None = None,
    ) -> dict | None:
        """Handle the rows of the logs in [watermark, upper); None if the limit is not above the watermark.

        ``step`` gets a ``Batch`` (a dict of them, if ``logs`` is one) and gives the output. Without ``upper`` the limit is
        just above the greatest sequence value at the start, less ``delay``. It is never above ``in_flight``.
        Rows with a null sequence have no place in the order: they come before all others, so the first run handles them and no other.
        """
        done = self.manifests()
        since = self._value(done[-1]["upper"]) if done else None
        named = logs if isinstance(logs, dict) else {"": logs}
        kinds = {n: df.schema[sequence].dataType for n, df in named.items()}
        if upper is None:
            upper = self._top(named, sequence, kinds, delay)
        if in_flight is not None and upper is not None:
            upper = min(upper, in_flight)
        if upper is None or since is not None and upper <= since:
            return None
        first = not any(m["output"] for m in done)
        batches = {n: self._batch(df, sequence, kinds[n], since, upper, first) for n, df in named.items()}
        output = f"data/{uuid.uuid4().hex}"
        step(batches if isinstance(logs, dict) else batches[""]).write.parquet(f"{self.root}/{output}")
        manifest = {"run": len(done), "since": self._text(since), "upper": self._text(upper), "output": output}
        self._commit(manifest)
        return manifest

    @staticmethod
    def _top(logs: dict[str, DataFrame], sequence: str, kinds: dict[str, T.DataType], delay: timedelta | int | None) -> datetime | int | None:
        each = [df.agg(_wall(F.max(sequence), kinds[n]).alias("top")) for n, df in logs.items()]
        tops = [r.top for r in reduce(DataFrame.unionByName, each).collect() if r.top is not None]  # one row a log
        if not tops:
            return None
        one = timedelta(microseconds=1) if isinstance(tops[0], datetime) else 1
        return max(tops) + one - (delay or 0 * one)

    @staticmethod
    def _batch(log: DataFrame, sequence: str, kind: T.DataType, since: datetime | int | None, upper: datetime | int, first: bool) -> Batch:
        at = F.col(sequence)
        lost = at.isNull() if first else F.lit(False)
        old = F.lit(False) if first else at.isNull()
        if since is not None:
            lost, old = lost | (at >= _literal(since, kind)), old | (at < _literal(since, kind))
        else:
            lost = lost | at.isNotNull()
        return Batch(log.where(lost & (at.isNull() | (at < _literal(upper, kind)))), log.where(old), since, upper)

    def _commit(self, manifest: dict) -> None:
        try:
            put_new(self.spark, f"{self.root}/commits/{manifest['run']:09d}.json", json.dumps(manifest))
        except FileExistsError as e:
            raise RuntimeError(f"run {manifest['run']} was committed by another job") from e

    def output(self) -> DataFrame | None:
        """All committed outputs; None if there is none."""
        paths = [f"{self.root}/{m['output']}" for m in self.manifests() if m["output"]]
        return self.spark.read.parquet(*paths) if paths else None

    def clean(self) -> None:
        """Remove outputs that no manifest names; only while no run is under way."""
        named = {(m["output"] or "").rsplit("/", 1)[-1] for m in self.manifests()}
        if self._fs.exists(self._path("data")):
            for s in self._fs.listStatus(self._path("data")):
                if s.getPath().getName() not in named:
                    self._fs.delete(s.getPath(), True)
