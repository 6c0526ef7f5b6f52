"""Modification stamps of tables: a table's stamp changes whenever it is changed or created anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_FOUND = "0" * 32  # stamp of a table nobody has changed yet


def stamp_column(identity: str):
    return F.md5(F.concat_ws("|", F.lit(identity), "tablename", F.col("createcount").cast("string"), F.col("stamp").cast("string")))


def table_stamps(tracked: DataFrame, identity: str, wanted: DataFrame | None = None) -> DataFrame:
    """(tablename, signature) of all tracked tables, or of the wanted ones, ``NOT_FOUND`` where there is none."""
    known = tracked.select("tablename", stamp_column(identity).alias("signature"))
    if wanted is None:
        return known
    return wanted.select("tablename").distinct().join(known, "tablename", "left").select("tablename", F.coalesce("signature", F.lit(NOT_FOUND)).alias("signature"))


def increment(tracked: DataFrame, changed: DataFrame) -> DataFrame:
    """``tracked`` (tablename, createcount, stamp) after a change of the named tables; new ones start at stamp 1."""
    named = changed.select("tablename").distinct().withColumn("_hit", F.lit(1).cast("bigint"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return tracked.join(named, "tablename", "full_outer").select("tablename", zero(F.col("createcount")).alias("createcount"), (zero(F.col("stamp")) + zero(F.col("_hit"))).alias("stamp"))


def recreated(tracked: DataFrame, names: DataFrame) -> DataFrame:
    """After the named tables were dropped and created again."""
    named = names.select("tablename").distinct().withColumn("_hit", F.lit(1).cast("bigint"))
    return tracked.join(named, "tablename", "left").select("tablename", (F.col("createcount") + F.coalesce("_hit", F.lit(0).cast("bigint"))).alias("createcount"), "stamp")


def combined(stamps: DataFrame) -> DataFrame:
    """One signature of all stamps, whatever their order; as many values as tables are gathered."""
    return stamps.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "tablename", "signature"))), ",")).alias("signature"))


def union_stamps(meta: DataFrame, tracked: DataFrame) -> DataFrame:
    """(kind, name, createcount, stamp): the store itself and its tables, without repeats."""
    zero = F.lit(0).cast("bigint")
    head = meta.select(F.lit(0).alias("kind"), F.col("identity").alias("name"), zero.alias("createcount"), zero.alias("stamp"))
    return head.unionByName(tracked.select(F.lit(1).alias("kind"), F.col("tablename").alias("name"), "createcount", "stamp")).distinct()
