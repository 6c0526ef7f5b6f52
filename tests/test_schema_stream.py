import datetime
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wayledger.operators import stamps
from wayledger.operators.crud import Store
from wayledger.plans import schema as S
from wayledger.streaming import jobs

TEXT = """
VERSION 3
CREATE SCHEMA survey;
CREATE TABLE "" base
{
    required  polyline  geometry  ""   # the shape
} INDEX(geometry);
CREATE TABLE "Road Lines" road : base
{
    "Main"
    required  int64     rowid     ""
    optional  uuid      node      "Start Node"  unit:kV
    "More"
    optional  text(50)  label     "Label"
    hasmany   photos    rowid     photo.road_id  order:date
    flags     explicitpull
} PRIMARY KEY(rowid) UNIQUE INDEX named(label);
CREATE TABLE "Photo" photo
{
    required pointzm(4326) place ""
    optional int64 road_id "Road"
};
CREATE SUFFIX TABLES { photo; _2019, _2020; };
"""


def test_parse():
    s = S.parse_schema(TEXT)
    assert (s.version, s.spaces, list(s.tables)) == (3, ("survey",), ["road", "photo", "photo_2019", "photo_2020"])
    road = s.tables["road"]
    assert [f.name for f in road.fields] == ["geometry", "rowid", "node", "label"]
    assert (road.primary_key().fields, road.field("label").type.width, road.field("node").unit, road.field("label").group) == (("rowid",), 50, "kV", "More")
    assert road.relations[0] == S.Relation("hasmany", "photos", "rowid", "photo.road_id", (("order", "date"),))
    assert str(s.tables["photo"].field("place").type) == "pointzm(4326)"
    assert road.struct()["rowid"].nullable is False and road.struct()["label"].metadata["type"] == "text(50)"


def test_print_and_parse_agree():
    s = S.parse_schema(TEXT)
    again = S.parse_schema(S.print_schema(s))
    assert S.print_schema(again) == S.print_schema(s)
    assert all(S.equal_tables(s.tables[n], again.tables[n]) for n in s.tables)


@pytest.mark.parametrize("bad", ['CREATE TABLE "x" x { required int65 a "" };', 'CREATE TABLE "x" x { required int64 a "" }', 'CREATE TABLE "x" x : y { };', 'CREATE TABLE "x" x { } INDEX(no);', "DROP TABLE x;"])
def test_bad_schemas(bad):
    with pytest.raises(S.SchemaError):
        S.parse_schema(bad)


def one(fields, tail=""):
    return S.parse_schema('CREATE TABLE "T" t { ' + fields + " }" + tail + ";")


def test_diff(spark):
    old = one('required int32 a "A" optional text old_name "Name" optional text gone "Gone"', " INDEX(a)")
    new = one('required int64 a "A" optional text new_name "Name" optional double fresh "Fresh"', " PRIMARY KEY(a)")
    changes = S.diff(old, new)
    assert [str(c) for c in changes] == ["drop index t.(a)", "change type t.a to int64", "rename field t.old_name -> new_name", "create field t.fresh", "drop field t.gone", "create index t.primary (a)"]
    assert len(S.ddl(changes)) == 4
    df = S.apply_changes(spark.createDataFrame([(1, "n", "g")], "a int, old_name string, gone string"), "t", changes)
    assert df.schema.simpleString() == "struct<a:bigint,new_name:string,fresh:double>"
    assert [str(c) for c in S.diff(S.Schema(), new)] == ["create table t"] and S.diff(new, new) == []
    assert "NOT NULL" in S.ddl(S.diff(S.Schema(), new))[0]


def test_equality_and_overlay():
    a, b = one('optional point g "" optional guid i ""').tables["t"], one('optional geometry g "" optional bin i ""').tables["t"]
    assert not S.equal_tables(a, b) and S.equal_tables(a, b, geometry_types=False, guids=False)
    assert not S.equal_tables(one('optional text(5) x ""').tables["t"], one('optional text x ""').tables["t"])
    assert S.equal_tables(one('optional text x ""').tables["t"], one('optional text(5) x ""').tables["t"])
    merged = S.overlay(one('optional text x "Title" unit:m optional text no "No"').tables["t"], one('optional text x ""').tables["t"])
    assert (merged.field("x").title, merged.field("x").unit, merged.field("no")) == ("Title", "m", None)


def test_migrations(spark, tmp_path):
    store, log = Store(spark, str(tmp_path / "m")), []
    make = lambda tx: tx.write("t", spark.createDataFrame([(1,)], "a int"))
    widen = lambda tx: tx.write("t", tx.read("t").withColumn("b", F.lit("x")))

    def fail(tx):
        raise KeyError("no")

    assert S.migrate(store, [[make]], log.append) == 1
    assert S.migrate(store, [[make], [widen]], log.append) == 2
    with pytest.raises(KeyError):
        S.migrate(store, [[make], [widen], [lambda tx: tx.truncate("t"), fail]])
    assert store.read("t").columns == ["a", "b"] and store.read("t").count() == 1
    assert S.migrate(store, [[make], [widen]], log.append) == 2 and log == ["migration 1", "migration 2"]


def test_stamps(spark):
    t = spark.createDataFrame([("a", 1, 5), ("b", 1, 2)], "tablename string, createcount bigint, stamp bigint")
    before = {r.tablename: r.signature for r in stamps.table_stamps(t, "id").collect()}
    after_df = stamps.increment(t, spark.createDataFrame([("a",), ("a",), ("c",)], "tablename string"))
    after = {r.tablename: r.signature for r in stamps.table_stamps(after_df, "id").collect()}
    assert before["a"] != after["a"] and before["b"] == after["b"] and "c" in after
    wanted = stamps.table_stamps(t, "id", spark.createDataFrame([("zz",)], "tablename string")).first().signature
    assert wanted == stamps.NOT_FOUND
    assert stamps.combined(stamps.table_stamps(t, "id")).first() == stamps.combined(stamps.table_stamps(t.orderBy(F.desc("tablename")), "id")).first()
    assert stamps.recreated(t, spark.createDataFrame([("b",)], "tablename string")).where("tablename = 'b'").first().createcount == 2


EDIT = "image string, dimension string, value string, at bigint"


def test_edit_stream(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    run = lambda: jobs.edit_stream(spark.readStream.schema(EDIT).json(folder), store, "label", ["image", "dimension"], [F.col("at")], str(tmp_path / "check"), available_now=True).awaitTermination()
    spark.createDataFrame([("a", "d", "1", 1), ("a", "d", "2", 2), ("b", "d", "9", 1)], EDIT).write.json(folder)
    run()
    spark.createDataFrame([("a", "d", "3", 3)], EDIT).write.mode("append").json(folder)
    run()
    assert sorted((r.image, r.value) for r in store.read("label").collect()) == [("a", "3"), ("b", "9")]
    jobs.apply_edits(store, "label", ["image", "dimension"], [F.col("at")])(spark.createDataFrame([("a", "d", "again", 9)], EDIT), 1)
    assert sorted((r.image, r.value) for r in store.read("label").collect()) == [("a", "3"), ("b", "9")]


def test_deltas_are_merged_and_compacted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    sink = jobs.apply_edits(store, "label", ["image", "dimension"], [F.col("at")], compact_after=2)
    for n in range(6):
        sink(spark.createDataFrame([("a", "d", str(n), n), (f"i{n}", "d", "x", n)], EDIT), n)
        assert {(r.image, r.value) for r in store.read("label").collect()} == {("a", str(n)), *((f"i{k}", "x") for k in range(n + 1))}
    assert len(store.deltas("label")) == 2 and len(store._names("log")) <= 4
    late = store.begin()
    with store.begin() as tx:
        tx.truncate("label")
        tx.commit()
    assert store.read("label").count() == 0 and not store.deltas("label")
    for n in (6, 7):
        sink(spark.createDataFrame([("a", "d", "x", n)], EDIT), n)
    store.vacuum(1)
    late.truncate("label")
    with pytest.raises(RuntimeError, match="first"):
        late.commit()


def test_failed_batch_is_done_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "d", "1", 1)], EDIT)
    sink = jobs.apply_edits(store, "label", ["image", "dimension"], [F.col("at")])
    with pytest.raises(Exception, match="lost"):
        sink(rows.withColumn("value", F.raise_error(F.lit("lost")).cast("string")), 0)
    assert store.tables() == {}
    sink(rows, 0)
    assert store.read("label").count() == 1


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_sessions(spark, tmp_path):
    rows = [("u", at(s)) for s in (0, 100, 400, 701, 5000)] + [("v", at(5))]
    df = spark.createDataFrame(rows, "user string, ts timestamp")
    got = sorted((r.user, r.n) for r in jobs.sessions(df, "user", "ts").collect())
    assert got == [("u", 1), ("u", 1), ("u", 3), ("v", 1)]
    for i, part in enumerate((rows, [("w", at(9000))], [("w", at(9999))])):
        spark.createDataFrame(part, "user string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema("user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.expire_sessions(stream, "user", "ts").writeStream.format("memory").queryName("expired").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {("v", 1), ("u", 5)} <= {(r.user, r.events) for r in spark.table("expired").collect()}
    assert jobs.progress(q)["batch"] >= 0


def test_analysis(spark, tmp_path):
    photos = spark.createDataFrame([(f"u{i}",) for i in range(20)], "url string").coalesce(1)
    fetch = lambda u: None if u == "u3" else u.encode()
    out = jobs.analysis_pipeline(photos, fetch, {"m": lambda b: [{"n": len(b)} for _ in b]}, "v2")
    rows = {r.url: r.counts for r in out.collect()}
    assert len(rows) == 20 and rows["u3"] is None and rows["u0"] == {"n": 7} and rows["u19"] == {"n": 4}
    sink = jobs.upload_batches(spark, str(tmp_path / "up"))
    (tmp_path / "up").mkdir()
    sink(out, 4)
    sink(out, 4)
    assert [p.name for p in (tmp_path / "up").glob("batch*")] == ["batch-000000004"]


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert jobs.retry(flaky, wait=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        jobs.retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, wait=waits.append)


def test_schema_of_existing_tables(spark):
    road = S.parse_schema(TEXT).tables["road"]
    df = spark.createDataFrame([], road.struct())
    back = S.table_of(df, "road")
    assert S.equal_tables(replace(road, indexes=()), back) and back.field("label").title == "Label"
    df.createOrReplaceTempView("road_view")
    assert list(S.catalog_schema(spark, tables=["road_view"]).tables) == ["road_view"]
