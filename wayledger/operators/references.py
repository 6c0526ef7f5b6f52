"""References to records that do not exist.

References and parent keys are co-partitioned and sorted by key and merged linearly
(a sort-merge join). Each parent key carries its validity: when it was first loaded, last
loaded and last deleted; these times tell missing, deleted and late parents apart.

A hot key does no harm: the references are first reduced to one row per (key, report
columns), with map-side combining, so that no key brings more rows into the merge than it
has distinct report values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING, DELETED, LATE = "missing", "deleted", "late"


def month_of(ts: str | Column) -> Column:
    """'YYYY-MM', or 'unknown' for a null time."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("unknown"))


def parent_validity(parents: DataFrame, key: str, loaded_at: str, deletes: DataFrame, delete_key: str, deleted_at: str) -> DataFrame:
    """(key, first_loaded, last_loaded, is_stored, is_deleted, last_deleted), one row per key of either table."""
    stored = parents.select(
        F.col(key).alias("key"),
        F.col(loaded_at).alias("loaded"),
        F.lit(None).cast(deletes.schema[deleted_at].dataType).alias("deleted"),
        F.lit(True).alias("stored"),
    )
    gone = deletes.select(
        F.col(delete_key).alias("key"),
        F.lit(None).cast(parents.schema[loaded_at].dataType).alias("loaded"),
        F.col(deleted_at).alias("deleted"),
        F.lit(False).alias("stored"),
    )
    return (
        stored.unionByName(gone)
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min("loaded").alias("first_loaded"),
            F.max("loaded").alias("last_loaded"),
            F.max("deleted").alias("last_deleted"),
            F.bool_or("stored").alias("is_stored"),
            F.bool_or(~F.col("stored")).alias("is_deleted"),
        )
    )


def orphan_references(
    references: DataFrame,
    reference_key: str,
    reference_loaded_at: str,
    parents: DataFrame,
    parent_key: str,
    parent_loaded_at: str,
    deletes: DataFrame,
    delete_key: str,
    deleted_at: str,
    report: dict[str, Column],
) -> DataFrame:
    """Distinct (reference key, report columns, reason) of the references without a valid parent.

    ``report`` names the columns to keep and how each is computed from ``references``.

    * 'deleted': the key was deleted and either never stored or last loaded before the last
      delete. A delete without a time counts only for keys that were never stored.
    * 'missing': neither stored nor deleted.
    * 'late': not deleted, and the reference was loaded before its parent's first load. Null
      load times on either side make nothing late.

    A null key refers to nothing and is not reported. Empty tables give no rows (an empty
    parent table makes every reference missing). Repeated rows count once; other columns of
    the inputs are ignored, whatever their names.
    """
    names = list(report)
    refs = (
        references.select(F.col(reference_key).alias("key"), *[c.alias(f"r{i}") for i, c in enumerate(report.values())], F.col(reference_loaded_at).alias("at"))
        .where(F.col("key").isNotNull())
        .groupBy("key", *[f"r{i}" for i in range(len(names))])
        .agg(F.min("at").alias("first_at"))
    )
    valid = parent_validity(parents, parent_key, parent_loaded_at, deletes, delete_key, deleted_at)
    stored, deleted = F.coalesce("is_stored", F.lit(False)), F.coalesce("is_deleted", F.lit(False))
    is_deleted = deleted & (~stored | F.coalesce(F.col("last_deleted") > F.col("last_loaded"), F.lit(False)))
    reason = (
        F.when(is_deleted, F.lit(DELETED))
        .when(~stored, F.lit(MISSING))
        .when(F.col("first_at") < F.col("first_loaded"), F.lit(LATE))
    )
    return (
        refs.hint("merge")
        .join(valid, "key", "left")
        .select(F.col("key").alias(reference_key), *[F.col(f"r{i}").alias(n) for i, n in enumerate(names)], reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def orphan_report(orphans: DataFrame, table: str, period: str) -> DataFrame:
    """Orphans per table, period and reason: (source_table, period, reason, n_orphans)."""
    return (
        orphans.groupBy(F.lit(table).alias("source_table"), F.col(period).alias("period"), "reason")
        .agg(F.count("*").alias("n_orphans"))
    )
