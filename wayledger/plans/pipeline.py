"""Queries of the general data-pipeline operators: orphan references, changed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.operators.incremental import IncrementalJob, last_good_start, newer_records
from wayledger.operators.references import month_of, orphan_references, orphan_report
from wayledger.plans.registry import Catalog
from wayledger.runtime import read, scratch

CATALOG = Catalog()

_ORPHANS = """
with parent as (select id, min(loaded_at) first_loaded, max(loaded_at) last_loaded from sample group by id),
gone as (select id, max(deleted_at) last_deleted from sample_delete group by id),
judged as (
  select l.sample_id, l.dimension, coalesce(strftime(l.modified_at, '%Y-%m'), 'unknown') as label_month,
    case when g.id is not null and (p.id is null or g.last_deleted > p.last_loaded) then 'deleted'
         when p.id is null then 'missing'
         when l.loaded_at < p.first_loaded then 'late' end as reason
  from label l left join parent p on p.id = l.sample_id left join gone g on g.id = l.sample_id
  where l.sample_id is not null)
"""


def _orphans(spark, d):
    label = read(spark, d, "label")
    return orphan_references(
        label, "sample_id", "loaded_at",
        read(spark, d, "sample"), "id", "loaded_at",
        read(spark, d, "sample_delete"), "id", "deleted_at",
        {"dimension": F.col("dimension"), "label_month": month_of("modified_at")},
    )


CATALOG.query("p2_found", _ORPHANS + "select distinct sample_id, dimension, label_month, reason from judged where reason is not null")(_orphans)


@CATALOG.query(
    "p2_report",
    _ORPHANS
    + """, found as (select distinct sample_id, dimension, label_month, reason from judged where reason is not null)
select 'label' as source_table, label_month as period, reason, count(*) as n_orphans from found group by all""",
)
def p2_report(spark, d):
    return orphan_report(_orphans(spark, d), "label", "label_month")


@CATALOG.query(
    "p4_found",
    """
with mark as (select max(started_at) as since from ingest_run where status = 'succeeded'),
log as (
  select 'sample' as source_table, id as sample_id, '' as dimension, modified_at, loaded_at from sample
  union all select 'label', sample_id, dimension, modified_at, loaded_at from label),
folded as (
  select source_table, sample_id, dimension,
    max(case when new_row then modified_at end) as new_version,
    max(case when not new_row then modified_at end) as seen_version,
    bool_or(new_row) as has_new, bool_or(not new_row) as has_seen
  from (select log.*, since is null or loaded_at is null or loaded_at >= since as new_row from log, mark)
  group by all)
select source_table, sample_id, dimension from folded
where has_new and (not has_seen or (new_version is not null and (seen_version is null or new_version > seen_version)))
""",
)
def p4_found(spark, d):
    """One run of a job that takes over from the last good run: its limits are fixed first, then output and watermark are committed together."""
    logs = {"sample": read(spark, d, "sample").withColumnRenamed("id", "sample_id").withColumn("dimension", F.lit("")), "label": read(spark, d, "label")}
    columns = ["sample_id", "dimension"]

    def step(batches):
        return reduce(DataFrame.unionByName, [newer_records(b.new, b.seen, columns, "modified_at").select(F.lit(n).alias("source_table"), *columns) for n, b in batches.items()])

    job = IncrementalJob(spark, scratch(spark, "changed"))
    since = last_good_start(read(spark, d, "ingest_run"))
    if since is not None:
        job.start_at(since)
    job.run({n: df.select(*columns, "modified_at", "loaded_at") for n, df in logs.items()}, "loaded_at", step)
    found = job.output()
    return spark.createDataFrame([], "source_table string, sample_id bigint, dimension string") if found is None else found
