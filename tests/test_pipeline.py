"""Orphan references and incremental runs: every case by hand, clean and dirty."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayledger.operators.incremental import IncrementalJob, changed_records, last_good_start, newer_records
from wayledger.operators.references import month_of, orphan_references, orphan_report

D = [dt(2024, 1, d) for d in range(1, 29)]


def orphans(spark, labels, samples, deletes):
    ref = spark.createDataFrame(labels, "sample_id long, dimension string, modified_at timestamp_ntz, loaded_at timestamp_ntz, reason string")
    par = spark.createDataFrame(samples, "id long, loaded_at timestamp_ntz, key string")
    gone = spark.createDataFrame(deletes, "id long, deleted_at timestamp_ntz")
    return orphan_references(ref, "sample_id", "loaded_at", par, "id", "loaded_at", gone, "id", "deleted_at", {"dimension": F.col("dimension"), "label_month": month_of("modified_at")})


def test_reasons(spark):
    labels = [(i, "d", D[5], D[5], "clash") for i in range(1, 8)] + [(1, "d", D[5], D[5], "clash"), (None, "d", D[5], D[5], ""), (2, None, None, None, "")]
    samples = [(1, D[1], ""), (3, D[1], ""), (3, D[9], ""), (4, D[7], ""), (5, D[1], ""), (6, D[20], ""), (6, D[7], "")]
    deletes = [(2, D[2]), (3, D[8]), (5, D[8]), (5, D[2]), (6, D[10]), (2, None)]
    got = {tuple(r) for r in orphans(spark, labels, samples, deletes).collect()}
    month = "2024-01"
    assert got == {(2, "d", month, "deleted"), (2, None, "unknown", "deleted"), (4, "d", month, "late"), (5, "d", month, "deleted"), (6, "d", month, "late"), (7, "d", month, "missing")}


def test_delete_at_the_load_is_no_delete(spark):
    assert orphans(spark, [(1, "d", D[5], D[5], "")], [(1, D[3], "")], [(1, D[3])]).count() == 0
    assert orphans(spark, [(1, "d", D[5], D[5], "")], [(1, D[3], "")], [(1, None)]).count() == 0


def test_empty_tables(spark):
    assert orphans(spark, [], [(1, D[1], "")], []).count() == 0
    assert [r.reason for r in orphans(spark, [(1, "d", D[1], D[1], "")], [], []).collect()] == ["missing"]


def test_hot_key_and_report(spark):
    labels = [(9, "x" * 100_000, D[i % 20], D[i % 20], "") for i in range(2000)]
    found = orphans(spark, labels, [], [])
    assert found.count() == 1
    assert orphan_report(found, "label", "label_month").first().n_orphans == 1


LOG = "k long, version timestamp_ntz, loaded timestamp_ntz, extra string"


def changed(spark, rows, since, **more):
    return sorted((r.k for r in changed_records(spark.createDataFrame(rows, LOG), ["k"], "loaded", "version", since, **more).collect()), key=str)


def test_changed_records(spark):
    rows = [
        (1, D[1], D[1], ""), (1, D[2], D[11], ""),  # newer
        (2, D[5], D[1], ""), (2, D[4], D[11], ""),  # older arrives late
        (3, D[5], D[1], ""), (3, D[5], D[11], ""),  # repeated
        (4, None, D[11], ""), (4, None, D[11], ""),  # new, without version
        (5, None, D[1], ""), (5, D[1], D[11], ""),  # version appears
        (6, D[1], D[1], ""), (6, None, D[11], ""),  # version lost
        (7, None, D[1], ""), (7, None, D[11], ""),
        (8, D[1], D[9], ""),
        (9, D[1], D[10], ""),  # loaded at the very start
        (None, D[1], D[12], ""),
        (10, D[1], None, ""),
    ]
    assert changed(spark, rows, D[10]) == [1, 10, 4, 5, 9, None]
    assert changed(spark, rows, D[10], upper=D[11]) == [10, 9]
    assert len(changed(spark, rows, None)) == 11
    assert changed(spark, [], D[10]) == []


def test_last_good_run(spark):
    runs = spark.createDataFrame([(1, D[1], D[2], "succeeded"), (2, D[3], D[20], "failed"), (3, D[2], None, "succeeded"), (3, D[2], None, "succeeded"), (4, D[9], None, "running"), (5, None, D[9], "succeeded")], "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string")
    assert last_good_start(runs) == D[2]
    assert last_good_start(runs.limit(0)) is None


def test_job_survives_failure_and_repeats_nothing(spark, tmp_path):
    log = lambda n: spark.createDataFrame([(i, D[i], D[i], "") for i in range(n)], LOG)
    job = IncrementalJob(spark, str(tmp_path / "job"))
    assert job.run(log(5), "loaded", lambda b: b.new)["run"] == 0
    with pytest.raises(Exception, match="lost"):
        job.run(log(9), "loaded", lambda b: b.new.withColumn("x", F.raise_error(F.lit("lost"))))
    assert job.watermark() < D[5] and job.output().count() == 5
    assert job.run(log(9), "loaded", lambda b: b.new)["run"] == 1
    assert sorted(r.k for r in job.output().collect()) == list(range(9))
    assert job.run(log(9), "loaded", lambda b: b.new) is None
    assert job.run(log(20), "loaded", lambda b: b.new, upper=D[12])["run"] == 2
    assert job.output().count() == 12
    job.clean()
    assert job.output().count() == 12 and len(list((tmp_path / "job/data").iterdir())) == 3 and len(list((tmp_path / "job/commits").glob("*.json"))) == 3


def test_two_jobs_at_once_commit_once(spark, tmp_path):
    job = IncrementalJob(spark, str(tmp_path / "race"))
    rows = spark.createDataFrame([(1, D[1], D[1], "")], LOG)

    def slow(b):
        IncrementalJob(spark, str(tmp_path / "race")).run(rows, "loaded", lambda x: x.new)
        return b.new

    with pytest.raises(RuntimeError, match="committed"):
        job.run(rows, "loaded", slow)
    assert job.output().count() == 1


def test_rows_in_flight_are_neither_lost_nor_repeated(spark, tmp_path):
    rows = lambda *at: spark.createDataFrame([(n, n) for n in at], "k long, seq long")
    job = IncrementalJob(spark, str(tmp_path / "flight"))
    assert job.run(rows(9, 10, 12), "seq", lambda b: b.new, in_flight=11)["upper"] == 11
    assert job.run(rows(9, 10, 12), "seq", lambda b: b.new, in_flight=11) is None
    assert job.run(rows(9, 10, 11, 12), "seq", lambda b: b.new)["upper"] == 13
    assert sorted(r.k for r in job.output().collect()) == [9, 10, 11, 12]
    late = IncrementalJob(spark, str(tmp_path / "late"))
    assert late.run(rows(9, 10, 12), "seq", lambda b: b.new, delay=2)["upper"] == 11
    assert late.run(rows(9, 10, 11, 12), "seq", lambda b: b.new, delay=0)["since"] == 11
    assert sorted(r.k for r in late.output().collect()) == [9, 10, 11, 12]


def test_batches_and_rows_without_a_sequence(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 4), ("b", 1, None), ("c", 1, 5), ("c", 1, 2), (None, 1, 4)], "k string, v int, seq long")
    step = lambda b: newer_records(b.new, b.seen, ["k"], "v")
    for broadcast in (100, 0):
        got = newer_records(rows.where("seq >= 4"), rows.where("seq < 4"), ["k"], "v", broadcast)
        assert {r.k for r in got.collect()} == {"a", None}
    job = IncrementalJob(spark, str(tmp_path / "steps"))
    job.start_at(4)
    job.start_at(4)
    seen = []
    assert job.run(rows, "seq", lambda b: seen.append((b.new.count(), b.seen.count(), b.since, b.upper)) or step(b))["run"] == 1
    assert seen == [(4, 2, 4, 6)] and sorted(str(r.k) for r in job.output().collect()) == ["None", "a", "b"]
    more = rows.union(spark.createDataFrame([("d", 1, 7)], rows.schema))
    job.start_at(1)
    job.run(more, "seq", step)
    assert sorted(str(r.k) for r in job.output().collect()) == ["None", "a", "b", "d"]
    two = IncrementalJob(spark, str(tmp_path / "two"))
    two.run({"x": rows, "y": rows.limit(0)}, "seq", lambda b: b["x"].new.select("k").union(b["y"].new.select("k")))
    assert two.output().count() == 6 and IncrementalJob(spark, str(tmp_path / "none")).run(rows.limit(0), "seq", step) is None


def test_numbered_sequence_and_zones(spark, tmp_path):
    job = IncrementalJob(spark, str(tmp_path / "numbers"))
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "k long, seq long")
    assert job.run(rows, "seq", lambda b: b.new)["upper"] == 12 and job.watermark() == 12
    assert job.run(rows, "seq", lambda b: b.new) is None and job.output().count() == 3
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Africa/Johannesburg")
        runs = spark.sql("select timestamp'2024-01-10 00:00:00' as started_at, 'succeeded' as status")
        since = last_good_start(runs)
        assert since == dt(2024, 1, 10)
        log = spark.sql("select 1L as k, timestamp'2024-01-09 23:59:59' as at, 1 as v union all select 2L, timestamp'2024-01-10 00:00:00', 1")
        assert [r.k for r in changed_records(log, ["k"], "at", "v", since).collect()] == [2]
        assert [r.k for r in changed_records(log.withColumn("at", F.col("at").cast("timestamp_ntz")), ["k"], "at", "v", since).collect()] == [2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
