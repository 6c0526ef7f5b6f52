"""Streams: batched edits, sessions that expire, staged photo analysis, motion state per track."""

from __future__ import annotations

import pickle
import time as clock
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayledger.operators.crud import Store, latest
from wayledger.operators.series import Motion, motion_schema, motion_step


def last_edits(edits: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last edit of each key of a micro-batch."""
    return latest(edits, key, order)


def apply_edits(store: Store, table: str, key: list[str], order: list[Column], compact_after: int = 100) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: last edits replace or join the rows of a table.

    The batch number is committed with the rows, so a batch that is delivered again changes nothing. A batch is
    written as a delta; after ``compact_after`` of them the table is written whole, and versions before the last two are removed.
    """

    def sink(batch: DataFrame, number: int) -> None:
        seen = {r.table: r.batch for r in store.read("_batches").collect()} if "_batches" in store.tables() else {}  # one row a table
        if seen.get(table, -1) >= number:
            return
        with store.begin() as tx:
            new = last_edits(batch, key, order)
            full = len(store.deltas(table)) >= compact_after
            if table not in store.tables():
                tx.write(table, new)
            elif full:
                old = store.read(table)
                every = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
                tx.write(table, latest(every, key, [F.col("_new")]).drop("_new"))
            else:
                tx.write_delta(table, number, key, new)
            tx.write("_batches", store.spark.createDataFrame(list((seen | {table: number}).items()), "table string, batch bigint"))
            tx.commit()
        if full:
            store.vacuum()

    return sink


def edit_stream(edits: DataFrame, store: Store, table: str, key: list[str], order: list[Column], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Micro-batches of edits every half second, or all there is."""
    writer = edits.writeStream.foreachBatch(apply_edits(store, table, key, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()


# --- sessions ----------------------------------------------------------------------------------------------


def sessions(events: DataFrame, user: str, time: str, gap_seconds: int = 300) -> DataFrame:
    """(user, session_start, session_end, n) of runs of events no more than ``gap_seconds`` apart.

    Spark's session windows merge map-side partial sessions, so a busy user is no hot spot.
    """
    w = F.session_window(F.col(time), f"{gap_seconds} seconds 1 microsecond")
    grouped = events.groupBy(user, w.alias("w")).agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), F.count("*").alias("n"))
    return grouped.select(user, "session_start", "session_end", "n")


def session_stream(events: DataFrame, user: str, time: str, idle: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream, each once it can get no more events."""
    watched = events.withWatermark(time, late)
    return watched.groupBy(user, F.session_window(time, idle).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("expires"), "n")


def expire_sessions(events: DataFrame, user: str, time: str, idle_ms: int = 300_000, late: str = "1 minute") -> DataFrame:
    """(user, events, last_us) of each session when it expires: custom state with an event-time timer."""
    user_type = events.schema[user].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({user: [key[0]], "events": [n], "last_us": [last]})
            return
        n, last = state.get if state.exists else (0, 0)
        for batch in batches:
            n += len(batch)
            last = max(last, int(batch[time].max().value // 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))

    watched = events.withWatermark(time, late).select(user, time)
    return watched.groupBy(user).applyInPandasWithState(step, f"{user} {user_type}, events bigint, last_us bigint", "events bigint, last_us bigint", "append", GroupStateTimeout.EventTimeTimeout)


# --- motion ------------------------------------------------------------------------------------------------------


def motion_stream(frames: DataFrame, track: str, t: str, dx: str, dy: str, diff: str, **options) -> DataFrame:
    """``series.motion_state`` over a stream: each batch's frames of a track, in order, continue its state.

    Frames that come later than newer ones of an earlier batch are taken as they come.
    """
    names = [track, t, dx, dy, diff]
    schema = motion_schema(frames.schema[track].dataType.simpleString(), track, t)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        motion = pickle.loads(state.get[0]) if state.exists else Motion()
        rows = pd.concat(list(batches)).sort_values(t, kind="stable")
        out = [(key[0], *r) for row in rows.itertuples(index=False) for r in motion_step(motion, row, t, dx, dy, diff, **options)]
        state.update((pickle.dumps(motion),))
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in schema.split(", ")])

    return frames.select(*names).groupBy(track).applyInPandasWithState(step, schema, "motion binary", "append", GroupStateTimeout.NoTimeout)


# --- photo analysis -----------------------------------------------------------------------------------------


def analysis_pipeline(photos: DataFrame, fetch: Callable[[str], bytes | None], models: dict[str, Callable[[list[bytes]], list[dict[str, int]]]], version: str, url: str = "url", batch: int = 8) -> DataFrame:
    """(url, model, version, counts) of photos through fetch and models, in batches of ``batch``.

    A photo that cannot be fetched yields null counts, so it is reported and not lost. The stages are functions of their
    input, so a repeated task gives the same rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                urls = part[url].iloc[i : i + batch].tolist()
                content = [fetch(u) for u in urls]
                good = [(u, c) for u, c in zip(urls, content) if c is not None]
                rows = [(u, name, version, None) for u, c in zip(urls, content) if c is None for name in models]
                for name, model in models.items():
                    rows += [(u, name, version, counts) for (u, _), counts in zip(good, model([c for _, c in good]) if good else [])]
                yield pd.DataFrame(rows, columns=["url", "model", "version", "counts"])

    return photos.select(url).mapInPandas(run, "url string, model string, version string, counts map<string,int>")


def retry(action: Callable[[], object], attempts: int = 5, wait: Callable[[float], None] | None = None):
    """The result of ``action``, tried again after 1, 2, 4, ... seconds."""
    for n in range(attempts):
        try:
            return action()
        except Exception:
            if n + 1 == attempts:
                raise
            (wait or clock.sleep)(2.0**n)


def upload_batches(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that writes each batch once, under its number."""

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def sink(batch: DataFrame, number: int) -> None:
        done = hadoop.Path(f"{folder}/batch-{number:09d}")
        if fs.exists(done):
            return
        draft = f"{folder}/.draft-{uuid.uuid4().hex}"
        batch.write.json(draft)
        if not fs.rename(hadoop.Path(draft), done):
            raise RuntimeError(f"batch {number} could not be put in place")

    return sink


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows and rates of the last batch of a stream."""
    p = query.lastProgress
    return {} if p is None else {"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond") or 0.0}
