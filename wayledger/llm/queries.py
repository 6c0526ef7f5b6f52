"""Queries of the training-data operators and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayledger.llm.leaks import leaked_items
from wayledger.llm.sampling import ProportionalSample
from wayledger.llm.splits import record_groups, split_assignment, split_targets
from wayledger.llm.stuffing import stuffed_pages
from wayledger.llm.terms import marked_terms
from wayledger.llm.text import photo_column, term_column
from wayledger.llm.tokens import encode_corpus
from wayledger.operators.labels import region_points
from wayledger.plans.registry import Catalog
from wayledger.runtime import read, spread

CATALOG = Catalog()
TOKENIZERS = "/opt/tokenizers"

# white space as Python's str.split has it
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _term_sql(column: str) -> str:
    return f"nullif(trim(regexp_replace(lower(nfc_normalize({column})), '{_SPACE}', ' ', 'g')), '')"


_TERMS = f"""
with term as (
  select 'category' as field, {_term_sql("category")} as term, sample_id from label
  union all select 'dimension', {_term_sql("dimension")}, sample_id from label),
counted as (select field, term, count(*) as occurrences, count(distinct sample_id) as records from term where term is not null group by all),
marked as (
  select *, case when records < 5 then 'rare'
    when records > 0.25 * (select count(distinct sample_id) from label) then 'common' end as mark
  from counted)
"""


def _terms(spark, d):
    return marked_terms(read(spark, d, "label"), ["category", "dimension"], "sample_id")


@CATALOG.query("p1_found", _TERMS + "select field, term, mark from marked where mark is not null")
def p1_found(spark, d):
    return _terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


CATALOG.query("p1_terms", _TERMS + "select field, term, occurrences, records, mark from marked")(_terms)

_PHOTO = r"""
list_aggregate(list_reduce(
  list_prepend([]::varchar[], list_transform(string_split(replace(lower(url_decode(string_split(image_path, '?')[1])), '\', '/'), '/'), lambda s: [s])),
  lambda a, x: case when x[1] = '..' then a[1:len(a) - 1] when x[1] in ('', '.') then a else list_concat(a, x) end), 'string_agg', '/')
"""


def _groups(spark, d):
    return record_groups(read(spark, d, "sample"), "id", photo_column(F.col("image_path")))


@CATALOG.query(
    "p3_found",
    f"""
with photo as (select distinct id, {_PHOTO} as photo from sample where image_path is not null),
first as (select photo, min(id) as first_id from photo where trim(photo) <> '' group by photo)
select distinct first_id, id from photo join first using (photo) where id > first_id
""",
)
def p3_found(spark, d):
    groups = _groups(spark, d)
    return groups.where(F.col("record") > F.col("group")).select(F.col("group").alias("first_id"), F.col("record").alias("id"))


@CATALOG.query("p3_linked")
def p3_linked(spark, d):
    """(first_id, id): samples linked by their photo or by the very same region, also through others."""
    entity = F.concat(F.lit("region "), F.trim("region"))
    every = read(spark, d, "sample").select("id", F.concat(F.lit("photo "), photo_column(F.col("image_path"))).alias("photo"), F.when(region_points("region").isNotNull(), entity).alias("region"))
    groups = record_groups(every.select("id", F.explode(F.array("photo", "region")).alias("entity")), "id", F.col("entity"))
    return groups.where(F.col("record") > F.col("group")).select(F.col("group").alias("first_id"), F.col("record").alias("id"))


@CATALOG.query("p3_splits")
def p3_splits(spark, d):
    """(sample_id, group_id, split): photos whole, samples without a photo each on their own."""
    ids = read(spark, d, "sample").select(F.col("id").alias("record")).where("record is not null").distinct()
    every = ids.join(_groups(spark, d), "record", "left").select(F.coalesce("group", "record").alias("group"), "record")
    label = spread(read(spark, d, "label").select("sample_id", "dimension", "category"))
    strata = label.select(F.col("sample_id").alias("record"), F.concat_ws(":", term_column(F.col("dimension")), term_column(F.col("category"))).alias("stratum")).distinct()
    placed = split_assignment(every, strata, split_targets(read(spark, d, "split_target")))
    return placed.select(F.col("record").alias("sample_id"), F.col("group").alias("group_id"), "split")


_UNITS = f"""
with pair as (select distinct {_term_sql("dimension")} as d, {_term_sql("category")} as c, sample_id from label where sample_id is not null),
seen as (select d, c, count(*) as have_rows from pair where d is not null and c is not null group by all),
report as (
  select t.dimension, t.category, t.want_rows, coalesce(s.have_rows, 0) as have_rows
  from category_target t left join seen s on s.d = {_term_sql("t.dimension")} and s.c = {_term_sql("t.category")})
"""


def _sample(spark, d):
    label = spread(read(spark, d, "label").select("sample_id", "dimension", "category"))
    units = label.select(term_column(F.col("dimension")).alias("k0"), term_column(F.col("category")).alias("k1"), F.col("sample_id").alias("record"))
    return ProportionalSample(units, read(spark, d, "category_target"), ["dimension", "category"])


@CATALOG.query("p5_found", _UNITS + "select distinct dimension, category from report where have_rows < want_rows")
def p5_found(spark, d):
    return _sample(spark, d).deficits().select("dimension", "category").distinct()


CATALOG.query("p5_report", _UNITS + "select distinct dimension, category, want_rows, have_rows from report where have_rows < want_rows")(lambda spark, d: _sample(spark, d).deficits())


@CATALOG.query("p5_sample")
def p5_sample(spark, d):
    """(dimension, category, sample_id): the drawn sample, keys in plain spelling."""
    return _sample(spark, d).draw().withColumnRenamed("record", "sample_id")


@CATALOG.query("p6_ids")
def p6_ids(spark, d, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json"):
    return encode_corpus(read(spark, d, "documents"), "text", ["doc_id"], vocabulary)


def _leaks(spark, d):
    return leaked_items(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_item"), "item_id", "text")


CATALOG.query("p7_found")(_leaks)


@CATALOG.query("p7_items")
def p7_items(spark, d):
    """(item_id, n_documents): the leaked items and in how many documents each leaks."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def _stuffed(spark, d):
    return stuffed_pages(read(spark, d, "documents"), "doc_id", "text")


@CATALOG.query("p8_found")
def p8_found(spark, d):
    return _stuffed(spark, d).select("doc_id")


@CATALOG.query("p8_shares")
def p8_shares(spark, d):
    """(doc_id, word_share, char_share): stuffed pages and how much of them is stuffing."""
    return _stuffed(spark, d).select("doc_id", F.round("word_share", 4).alias("word_share"), F.round("char_share", 4).alias("char_share"))
