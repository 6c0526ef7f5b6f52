from collections import defaultdict

import pytest
from compare import assert_same, database
from pyspark.sql import functions as F

from wayledger.llm.queries import CATALOG
from wayledger.llm.text import photo_column
from wayledger.operators.labels import region_points


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", list(CATALOG.sql))
def test_agrees_with_sql(spark, data, con, name):
    assert_same(CATALOG.queries[name](spark, data), con, CATALOG.sql[name])


def test_splits_hold_photos_together(spark, data):
    placed = CATALOG.queries["p3_splits"](spark, data).toPandas()
    assert placed.sample_id.is_unique and placed.groupby("group_id").split.nunique().max() == 1
    assert set(placed.sample_id) == {r.id for r in spark.read.parquet(f"{data}/sample.parquet").select("id").distinct().collect()}
    shares = placed.split.value_counts(normalize=True)
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["test"] - 0.1) < 0.03


def test_linked_samples_against_union_find(spark, data):
    rows = spark.read.parquet(f"{data}/sample.parquet").select("id", photo_column(F.col("image_path")).alias("photo"), F.trim("region").alias("region"), region_points("region").isNotNull().alias("good")).collect()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        for entity in [("photo", r.photo)] * (r.photo is not None) + [("region", r.region)] * r.good:
            if r.id is not None:
                parent[root(r.id)] = root(entity)
    groups = defaultdict(set)
    for i in [x for x in parent if isinstance(x, int)]:
        groups[root(i)].add(i)
    want = {(min(g), i) for g in groups.values() for i in g if i > min(g)}
    got = [(r.first_id, r.id) for r in CATALOG.queries["p3_linked"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(groups) < len({r.photo for r in rows})


def test_sample_has_exact_counts(spark, data):
    drawn = CATALOG.queries["p5_sample"](spark, data)
    assert drawn.count() == drawn.distinct().count()
    counts = {(r.dimension, r.category): r["count"] for r in drawn.groupBy("dimension", "category").count().collect()}
    missing = {(r.dimension, r.category): r.have_rows for r in CATALOG.queries["p5_report"](spark, data).collect()}
    for t in spark.read.parquet(f"{data}/category_target.parquet").collect():
        key = t.dimension, t.category
        assert counts.get(key, 0) == missing.get(key, t.want_rows)


def test_stuffed_pages_of_the_data(spark, data):
    shares = CATALOG.queries["p8_shares"](spark, "/root/testdata/sf0.01").collect()
    assert 40 < len(shares) < 80 and all(r.word_share > 0.5 and r.char_share > 0.5 for r in shares)
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert not any(text[r.doc_id].startswith("Run of ") for r in shares)
