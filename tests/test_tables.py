import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.functions import scalars
from wayledger.operators import crud, table
from wayledger.operators import labels as L


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (3, "d")], "id int, name string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_filters_after_each_other(spark, people):
    left = table.semi_filter(people, "ID", spark.createDataFrame([(3,), (3,), (1,), (None,)], "k int"), "k")
    assert rows(table.semi_filter(left, "name", spark.createDataFrame([("c",), ("a",)], "n string"), "n")) == [(1, "a"), (3, "c")]


def test_sort_by_named_fields(people):
    assert [r.id for r in table.sort_by(people, ["name"]).collect()] == [2, 1, 3, 3]
    with pytest.raises(table.TableError):
        table.sort_by(people, ["nothing"])


def test_positions(spark, people):
    assert rows(table.erase_rows(people, ["id", "name"], [0, 3])) == [(2, None), (3, "c")]
    assert rows(table.erase_rows(people, ["id", "name"], [])) == rows(people)
    assert (3, "z") in rows(table.set_cell(people, ["id", "name"], 3, "name", "z"))
    big = spark.range(1000).withColumn("v", -F.col("id"))
    assert table.with_position(big, ["v"]).where(F.col("row_index") != 999 - F.col("id")).count() == 0
    assert table.with_position(big.limit(0), ["v"]).count() == 0


def test_fields(people):
    assert table.add_field(people, "x", "double").schema["x"].dataType == T.DoubleType()
    for bad in (lambda: table.add_field(people, "id", "int"), lambda: table.rename_field(people, "no", "x"), lambda: table.rename_field(people, "id", "name"), lambda: table.delete_fields(people, "no")):
        with pytest.raises(table.TableError):
            bad()
    assert table.keep_fields(people, "NAME").columns == ["name"]
    assert table.unique_fields(people.select("id", "name", F.lit(1).alias("id"))).columns == ["id", "name"]


def test_rows(spark, people):
    assert (9, None) in rows(table.add_rows(people, spark.createDataFrame([(9,)], "id int")))
    with pytest.raises(table.TableError):
        table.add_rows(people, spark.createDataFrame([(9,)], "other int"))
    with pytest.raises(table.TableError):
        table.add_full_row(people, [1])
    assert table.check_columns({"a": [1, None], "b": ["x", "y"]}) == 2
    for bad in ({"a": [1], "b": []}, {"a": [None]}):
        with pytest.raises(table.TableError):
            table.check_columns(bad)


def test_state_and_types(people):
    t = table.Table(people)
    assert t.populated and not t.clear().populated and t.clear_rows().populated and t.clear_rows().df.count() == 0
    assert table.column_type([None, 2.5]) == T.DoubleType() and table.column_type([None]) == T.IntegerType()
    assert table.widened(T.IntegerType(), T.DoubleType()) == T.DoubleType() and table.widened(T.IntegerType(), T.StringType()) == T.StringType()


def test_crud(spark, people):
    source = spark.createDataFrame([(2, "b", 1), (2, "bb", 2), (7, "g", 1)], "id int, name string, v int")
    out = crud.upsert(people.where("id < 3"), source, ["id"], [F.col("v")])
    assert rows(out) == [(1, "a"), (2, "bb"), (7, "g")]
    nulled = crud.upsert(people.where("id < 3"), spark.createDataFrame([(1, None)], "id int, name string"), ["id"])
    assert (1, None) in rows(nulled)
    with pytest.raises(ValueError):
        crud.upsert(people, source.drop("id"), ["id"])
    assert crud.one_row(people.where("id = 1")).name == "a" and crud.one_row(people.where("id = 0")) is None
    with pytest.raises(crud.RowCountError):
        crud.one_row(people)
    assert rows(crud.exists(spark.createDataFrame([(1,), (1,), (5,), (None,)], "k int"), people, "k", "id")) == [(1, True), (1, True), (5, False), (None, False)]
    with pytest.raises(ValueError):
        crud.page(people, [], 1)


def test_errors(spark, people):
    kinds = []
    for bad in (lambda: spark.sql("select * from nowhere"), lambda: people.select("nothing"), lambda: spark.sql("selct 1"), lambda: 1 / 0):
        try:
            bad()
        except Exception as e:
            kinds.append(crud.error_kind(e))
    assert kinds == ["table not found", "field not found", "syntax", "other"]


def test_transactions(spark, people, tmp_path):
    store = crud.Store(spark, str(tmp_path / "store"))
    with store.begin() as tx:
        tx.write("people", people)
        tx.commit()
    with store.begin() as tx:
        tx.truncate("people")
    assert store.read("people").count() == 4
    with pytest.raises(KeyError), store.begin() as tx:
        tx.truncate("people")
        raise KeyError
    assert store.read("people").count() == 4
    first, second = store.begin(), store.begin()
    first.truncate("people")
    second.truncate("people")
    first.commit()
    with pytest.raises(RuntimeError):
        second.commit()
    assert store.read("people").count() == 0


# --- edits of the label store --------------------------------------------------------------------------------


def test_commands_run_in_turn(spark):
    samples = spark.createDataFrame([(1, "a", 0, None), (2, "a", 1, "r1"), (3, "a", 2, "r2"), (4, "a", 2, "r2"), (5, "b", 7, "r7"), (6, "c", None, "x")], "id long, image_path string, region_id long, region string")
    samples = samples.withColumns({"author": F.lit("old"), "modified_at": F.lit(None).cast("timestamp_ntz")})
    labels = spark.createDataFrame([(2, "d", "one", 1.0), (3, "d", "two", None), (5, "d", "seven", 2.0), (6, "d", "six", None)], "sample_id long, dimension string, category string, intensity double")
    labels = labels.withColumns({"author": F.lit("old"), "modified_at": F.lit(None).cast("timestamp_ntz")})
    commands = [
        (1, "a", 2, "new", "d", "edited"), (2, "a", 2, "newer", "e", "more"), (3, "a", 2, "", "d", "x"), (4, "a", 2, "lost", "d", "x"),  # gone by then
        (5, "a", 0, "made", "d", "takes the number again"), (6, "a", 2, "moved", "e", "again"), (7, "a", 1, "r1", "d", ""), (8, "a", None, "", "f", "whole"),
        (9, "z", 0, "", "d", "first"), (10, "z", 0, "", "d", "second"), (11, "z", 0, "poly", "d", "region"), (12, "nowhere", 4, "r", "d", "x"),
    ]
    c = spark.createDataFrame([(*x, None, "me", dt.datetime(2024, 1, 1)) for x in commands], "n int, image string, region_id long, region string, dimension string, category string, intensity double, author string, modified_at timestamp_ntz")
    after, edited = L.set_labels(samples, labels, c, order=("n",))
    got = {(r.id, r.image_path, r.region_id, r.region) for r in after.collect()}
    assert {x[1:] for x in got} == {("a", 0, None), ("a", 1, "r1"), ("a", 2, "moved"), ("b", 7, "r7"), ("c", None, "x"), ("z", 0, None), ("z", 1, "poly")}
    ids = {x[1:3]: x[0] for x in got}
    assert len({x[0] for x in got}) == 7 and {i for k, i in ids.items() if k in (("a", 2), ("z", 0), ("z", 1))} == {7, 8, 9}
    want = {(ids["a", 2], "d", "takes the number again"), (ids["a", 2], "e", "again"), (1, "f", "whole"), (ids["z", 0], "d", "second"), (ids["z", 1], "d", "region"), (5, "d", "seven"), (6, "d", "six")}
    assert {(r.sample_id, r.dimension, r.category) for r in edited.collect()} == want
    none, same = L.set_labels(samples, labels, c.limit(0))
    assert none.count() == 6 and same.count() == 4


def test_repeated_keys_of_an_upsert_fail(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="repeated"):
        crud.upsert(target, spark.createDataFrame([(1, "b"), (1, "c")], target.schema), ["k"]).collect()
    assert crud.update_by_key(target, spark.createDataFrame([(1, "b"), (2, "c")], target.schema), ["k"]).collect() == [(1, "b")]


def test_a_pattern_matches_the_whole_text(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("a\nc",)], "t string")
    assert [r[0] for r in df.select(scalars.wildcard(F.col("t"), "abc")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(scalars.wildcard(F.col("t"), "a?c")).collect()] == [True, False, True]


def test_rows_one_by_one_and_sinks(spark, tmp_path):
    df = spark.range(1000).repartition(3)
    assert sorted(r.id for r in crud.iterate(df)) == list(range(1000))

    def sink(batches):
        total = sum(sum(b.column(0).to_pylist()) for b in batches)
        (tmp_path / f"{total}").write_text("")

    assert crud.consume(df, sink) == 1000 and sum(int(p.name) for p in tmp_path.iterdir()) == sum(range(1000))
    assert crud.consume(df.limit(0), sink) == 0
    with pytest.raises(Exception, match="ZeroDivisionError"):
        list(crud.iterate(df.mapInArrow(lambda b: [1 / 0], "id long")))
