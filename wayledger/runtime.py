"""Session helpers shared by the operators: table reading, staging, size checks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: dict[str, SparkSession] = {}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once an application; they need not have it installed.

    The driver serves the archive itself, so no executor reads the driver's disk.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="wayledger-"), "wayledger.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="wayledger-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}-{name}"
    _staged[path] = spark
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage like a checkpoint, but the copy is columnar, compressed and
    survives the loss of any executor. The files go when the process ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of staged tables that ``df`` reads and that are not needed any more."""
    for file in df.inputFiles():
        path = file.rsplit("/", 1)[0]
        for known in [p for p in _staged if p.split(":")[-1].lstrip("/") == path.split(":")[-1].lstrip("/")]:
            _delete(_staged.pop(known), known)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place, whole and at once; FileExistsError if there is one of that name.

    Atomic and exclusive on HDFS and file systems like it (a rename that may not overwrite) and on local and
    network disks (a hard link). Object stores without either need a committer of their own.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".draft-{uuid.uuid4().hex}")
    fs.mkdirs(final.getParent())
    stream = fs.create(draft)
    stream.write(text.encode())
    stream.close()
    try:
        if fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), final.toUri().getPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, final, options)
    except Py4JJavaError as e:
        if fs.exists(final):
            raise FileExistsError(path) from e
        raise
    finally:
        fs.delete(draft, False)


HOT_KEYS = 50_000  # a key with more than this part of all rows is hot, so there are no more hot keys than that
HOT_ROWS = 10_000  # rows below which no key is hot
HOT_BYTES = 64 << 20  # bytes of rows that a broadcast of hot keys may hold
SALTS = 64  # tasks that share a hot key where its row is too long for a broadcast


def weighted_join(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, one row per key, whose ``weight`` is the key's rows in ``rows``.

    Keys with more than total / HOT_KEYS rows are hot. There can be no more than HOT_KEYS of them. Their rows
    are broadcast if they take at most HOT_BYTES, and all others are shuffled by key, so no key of theirs is large.
    Longer rows are not broadcast: then hot keys are salted, and only 8 bytes a key tell them apart.
    """
    hot = F.col(weight) > F.lit(max(HOT_ROWS, total // HOT_KEYS))
    if total <= HOT_ROWS or keyed.where(hot).isEmpty():
        return rows.join(keyed, key)
    held = stage(keyed.where(hot), "hot")
    size = held.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    if size > HOT_BYTES:
        return _salted_join(rows, keyed, key, held)
    cold = rows.join(F.broadcast(held.select(key)), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(F.broadcast(held), key).select(*cold.columns).unionByName(cold)


def _salted_join(rows: DataFrame, keyed: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join in which each row of a key in ``hot`` meets one of SALTS copies of the key's row."""
    marks = hot.select(F.xxhash64(key).alias("_mark")).distinct().withColumn("_hot", F.lit(True))
    marked = lambda df: df.withColumn("_mark", F.xxhash64(key)).join(F.broadcast(marks), "_mark", "left").drop("_mark")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = marked(rows).withColumn("_salt", salt).drop("_hot")
    right = marked(keyed).withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


@atexit.register
def _clean() -> None:
    for path, spark in list(_staged.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work in Python.

    Only an input that comes in fewer splits than cores is moved; larger ones stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows
