"""Queries of the expression language, the table operators and the CRUD operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.operators import crud, table
from wayledger.plans.expression import to_column, where
from wayledger.plans.registry import Catalog
from wayledger.runtime import read

CATALOG = Catalog()
q = CATALOG.query


@q("flagship_report", "select event_type, value >= 50 as high, count(*) as n from events where value >= 10 and event_type <> 'error' group by all order by n desc")
def flagship_report(spark, d):
    events = where(read(spark, d, "events"), "value >= 10 AND event_type != 'error'")
    return events.groupBy("event_type", to_column("value >= 50", events).alias("high")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@q("expr_logic", "select o_orderkey, not (o_totalprice > 100000 or o_orderstatus = 'F') and o_orderpriority <> '5-LOW' as hit from orders")
def expr_logic(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", to_column("NOT (o_totalprice > 100000 OR o_orderstatus = 'F') AND o_orderpriority <> '5-LOW'", o).alias("hit"))


@q("expr_case", "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'part' end as state, case when o_totalprice < 50000 then 1 when o_totalprice < 150000 then 2 end as size from orders")
def expr_case(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", to_column("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END", o).alias("state"), to_column("case when o_totalprice < 50000 then 1 when o_totalprice < 150000 then 2 end", o).alias("size"))


@q("expr_in_like", "select p_partkey from part where p_size in (1, 7, 9) and p_type not in ('x') and p_brand like 'Brand#%' and p_name not like '%zzz%'")
def expr_in_like(spark, d):
    return where(read(spark, d, "part"), "p_size IN (1, 7, 9) and p_type NOT IN ('x') and p_brand LIKE 'Brand#%' and p_name not like '%zzz%'").select("p_partkey")


@q("expr_like_nocase", "select p_partkey from part where p_brand ilike 'brand#1%'")
def expr_like_nocase(spark, d):
    p = read(spark, d, "part")
    return p.where(to_column("p_brand LIKE 'brand#1%'", p, like="nocase")).select("p_partkey")


@q(
    "expr_null_compat",
    """select sample_id, dimension, loaded_at, author is not distinct from null as no_author, (author is not null and author < 'grader-1') or author is null as low,
      not ((author is not null and author < 'grader-1') or author is null) as high, author is distinct from 'grader-02' as other from label""",
)
def expr_null_compat(spark, d):
    x = read(spark, d, "label")
    c = {"no_author": "author = NULL", "low": "author < 'grader-1'", "high": "author >= 'grader-1'", "other": "author != 'grader-02'"}
    return x.select("sample_id", "dimension", "loaded_at", *[to_column(e, x, "compat").alias(n) for n, e in c.items()])


@q("expr_null_tests", "select sample_id, dimension, loaded_at, author is null as a, author is not null as b, author is not distinct from 'grader-02' as c, modified_at is null as e from label")
def expr_null_tests(spark, d):
    x = read(spark, d, "label")
    c = {"a": "author ISNULL", "b": "author NOT NULL", "c": "author IS 'grader-02'", "e": "modified_at is null"}
    return x.select("sample_id", "dimension", "loaded_at", *[to_column(e, x).alias(n) for n, e in c.items()])


@q("expr_arith", "select l_orderkey, l_linenumber, l_quantity * 2.0 + 1 as a, -l_linenumber + 10 - 3 as b, l_linenumber % 3 as c, l_extendedprice / 4 as e from lineitem")
def expr_arith(spark, d):
    x = read(spark, d, "lineitem")
    c = {"a": "l_quantity * 2 + 1", "b": "-l_linenumber + 10 - 3", "c": "l_linenumber % 3", "e": "l_extendedprice / 4"}
    return x.select("l_orderkey", "l_linenumber", *[to_column(e, x).alias(n) for n, e in c.items()])


_PREFIX = r"try_cast(regexp_extract({}, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) as double)"


@q("expr_text_number", f"select o_orderkey, {_PREFIX.format('o_orderpriority')} > 2 as late from orders where {_PREFIX.format('o_orderpriority')} <> 3")
def expr_text_number(spark, d):
    o = read(spark, d, "orders")
    return o.where(to_column("o_orderpriority <> 3", o)).select("o_orderkey", to_column("o_orderpriority > 2", o).alias("late"))


@q("expr_cast", f"select c_custkey, cast({_PREFIX.format('split_part(c_name, chr(35), 2)')} as bigint) as n, cast(c_custkey as varchar) || '/' || c_mktsegment as label, cast(c_acctbal as float) as f from customer")
def expr_cast(spark, d):
    c = read(spark, d, "customer").withColumn("number", F.split_part("c_name", F.lit("#"), F.lit(2)))
    return c.select("c_custkey", to_column("CAST(number AS int64)", c).alias("n"), to_column("cast(c_custkey as text) || '/' || c_mktsegment", c).alias("label"), to_column("cast(c_acctbal as float)", c).alias("f"))


@q("expr_functions", "select c_custkey, abs(c_acctbal) as a, lower(c_mktsegment) as b, upper(c_name) as c, length(c_name) as e, substring(c_name, 2, 3) as f, round(c_acctbal, 1) as g from customer")
def expr_functions(spark, d):
    c = read(spark, d, "customer")
    e = {"a": "abs(c_acctbal)", "b": "lower([c_mktsegment])", "c": "UPPER(c_name)", "e": "len(c_name)", "f": "mid(c_name, 2, 3)", "g": "round(c_acctbal, 1)"}
    return c.select("c_custkey", *[to_column(x, c).alias(n) for n, x in e.items()])


@q("expr_aggregates", "select c_mktsegment, count(*) as n, min(c_acctbal) as low, max(c_acctbal) as high, round(avg(c_acctbal), 6) as mean, round(sum(c_acctbal), 4) as total from customer group by c_mktsegment")
def expr_aggregates(spark, d):
    c = read(spark, d, "customer")
    e = {"n": "count(*)", "low": "min(c_acctbal)", "high": "max(c_acctbal)", "mean": "round(avg(c_acctbal), 6)", "total": "round(sum(c_acctbal), 4)"}
    return c.groupBy("c_mktsegment").agg(*[to_column(x, c).alias(n) for n, x in e.items()])


@q("expr_params", "select p_partkey, p_size from part where p_size > 10 and p_brand = 'Brand#12'")
def expr_params(spark, d):
    return where(read(spark, d, "part"), "p_size > $1 and p_brand = $2", params=(10, "Brand#12")).select("p_partkey", "p_size")


@q("expr_unix_time", "select event_id, epoch_us(ts) / 1e6 as seconds from events where epoch_us(ts) / 1e6 > 1705000000")
def expr_unix_time(spark, d):
    e = read(spark, d, "events")
    return e.where(to_column("unix_timestamp(ts) > 1705000000", e)).select("event_id", to_column("unix_timestamp(ts)", e).alias("seconds"))


# --- tables --------------------------------------------------------------------------------------


@q("semi_filter", "select c_custkey, c_name from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def semi_filter(spark, d):
    return table.semi_filter(read(spark, d, "customer"), "C_NATIONKEY", where(read(spark, d, "nation"), "n_regionkey = 1"), "n_nationkey").select("c_custkey", "c_name")


@q(
    "semi_filter_chain",
    "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F' and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')) and l_partkey in (select p_partkey from part where p_size < 10)",
)
def semi_filter_chain(spark, d):
    customers = where(read(spark, d, "customer"), "c_mktsegment = 'BUILDING'")
    orders = table.semi_filter(where(read(spark, d, "orders"), "o_orderstatus = 'F'"), "o_custkey", customers, "c_custkey")
    lines = table.semi_filter(read(spark, d, "lineitem"), "l_orderkey", orders, "o_orderkey")
    return table.semi_filter(lines, "l_partkey", where(read(spark, d, "part"), "p_size < 10"), "p_partkey").select("l_orderkey", "l_linenumber")


@q("sort_multi", "select sample_id, dimension, author from label order by author nulls first, dimension, sample_id")
def sort_multi(spark, d):
    return table.sort_by(read(spark, d, "label").select("sample_id", "dimension", "author"), ["author", "dimension", "sample_id"])


@q("erase_rows", "select c_custkey, c_name from (select *, row_number() over (order by c_custkey) - 1 as i from customer) where i not in (0, 5, 17)")
def erase_rows(spark, d):
    return table.erase_rows(read(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], [0, 5, 17])


@q("set_cell", "select s_suppkey, case when i = 3 then 'changed' else s_name end as s_name from (select *, row_number() over (order by s_suppkey) - 1 as i from supplier)")
def set_cell(spark, d):
    return table.set_cell(read(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], 3, "s_name", "changed")


@q("add_rename_drop", "select n_nationkey as key, n_name, cast(null as double) as score from nation")
def add_rename_drop(spark, d):
    n = table.add_field(read(spark, d, "nation"), "score", "double")
    return table.delete_fields(table.rename_field(n, "n_nationkey", "key"), "N_REGIONKEY")


@q("attach_column", "select c_custkey, s_name from (select c_custkey, row_number() over (order by c_custkey) as i from customer) left join (select s_name, row_number() over (order by s_suppkey) as i from supplier) using (i)")
def attach_column(spark, d):
    return table.attach(read(spark, d, "customer").select("c_custkey"), ["c_custkey"], read(spark, d, "supplier"), ["s_suppkey"], "s_name", "s_name")


@q("add_row_missing", "select r_regionkey, r_name from region union all select 99, null")
def add_row_missing(spark, d):
    return table.add_rows(read(spark, d, "region"), spark.createDataFrame([(99,)], "r_regionkey int"))


@q("column_all_null", "select count(poly) = 0 as poly, true as nothing, count(severity) = 0 as severity from frame_label where x1 is not null and poly is null")
def column_all_null(spark, d):
    return table.all_null(where(read(spark, d, "frame_label"), "x1 is not null and poly is null"), ["poly", "nothing", "severity"])


@q("dup_column_store", "select o_orderkey, o_custkey, cast(floor(o_totalprice) as bigint) as o_totalprice from orders")
def dup_column_store(spark, d):
    o = read(spark, d, "orders")
    twice = o.select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("o_totalprice"), F.lit(1).alias("o_orderkey"))
    return table.store(twice, {"o_totalprice": T.LongType()})


@q("project_nocase", "select p_partkey as \"P_PARTKEY\", p_size as \"P_Size\" from part")
def project_nocase(spark, d):
    return table.project(read(spark, d, "part"), ["P_PARTKEY", "P_Size"])


@q("merge_schemas", "select cast(c_custkey as bigint) as key, c_name as name, cast(null as varchar) as mark from customer union all select s_suppkey, s_name, 'supplier' from supplier")
def merge_schemas(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("key"), F.col("c_name").alias("name"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("mark"))
    return table.merge_schemas(c, s)


@q("row_index", "select row_number() over (order by o_orderdate, o_orderkey) - 1 as row_index, o_orderkey from orders")
def row_index(spark, d):
    return table.with_position(read(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("row_index", "o_orderkey")


# --- CRUD ----------------------------------------------------------------------------------------


@q("append_rows", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier union all select c_custkey, c_name, c_nationkey, null from customer where c_custkey <= 5")
def append_rows(spark, d):
    c = where(read(spark, d, "customer"), "c_custkey <= 5").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_nationkey").alias("s_nationkey"))
    return crud.append(read(spark, d, "supplier"), c)


@q("insert_one", "select r_regionkey, r_name from region union all select 7, 'POLAR'")
def insert_one(spark, d):
    return crud.insert_one(read(spark, d, "region"), r_regionkey=7, r_name="POLAR")


_EDITS = "select c_custkey, 'moved' as c_mktsegment, c_acctbal + 1 as c_acctbal from customer where c_custkey % 10 = 0 union all select c_custkey + 1000000, 'new', 0 from customer where c_custkey % 100 = 0"


def _edits(spark, d):
    c = read(spark, d, "customer")
    old = where(c, "c_custkey % 10 = 0").select("c_custkey", F.lit("moved").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return old.unionByName(where(c, "c_custkey % 100 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal")))


@q("upsert_key", f"with e as ({_EDITS}) select coalesce(c.c_custkey, e.c_custkey) as c_custkey, c_name, coalesce(e.c_mktsegment, c.c_mktsegment) as c_mktsegment, coalesce(e.c_acctbal, c.c_acctbal) as c_acctbal from customer c full join e on c.c_custkey = e.c_custkey")
def upsert_key(spark, d):
    return crud.upsert(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), _edits(spark, d), ["c_custkey"])


@q("update_key", f"with e as ({_EDITS}) select c.c_custkey, c_name, coalesce(e.c_mktsegment, c.c_mktsegment) as c_mktsegment, coalesce(e.c_acctbal, c.c_acctbal) as c_acctbal from customer c left join e on c.c_custkey = e.c_custkey")
def update_key(spark, d):
    return crud.update_by_key(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), _edits(spark, d), ["c_custkey"])


@q("delete_key", f"with e as ({_EDITS}) select c_custkey, c_name from customer where c_custkey not in (select c_custkey from e)")
def delete_key(spark, d):
    return crud.delete_by_key(read(spark, d, "customer"), _edits(spark, d), ["c_custkey"]).select("c_custkey", "c_name")


@q("exists_keys", "select sample_id, sample_id is not null and sample_id in (select id from sample) as found from (select distinct sample_id from label)")
def exists_keys(spark, d):
    return crud.exists(read(spark, d, "label").select("sample_id").distinct(), read(spark, d, "sample"), "sample_id", "id")


@q("latest_version", "select sample_id, dimension, category, intensity, author from (select *, row_number() over (partition by sample_id, dimension order by modified_at desc nulls last, loaded_at desc, category desc nulls last, intensity desc nulls last, author desc nulls last) as n from (select * replace (case when not isnan(intensity) then intensity end as intensity) from label)) where n = 1")
def latest_version(spark, d):
    x = read(spark, d, "label").withColumn("intensity", F.nanvl("intensity", F.lit(None).cast("double")))  # a store has no NaN
    return crud.latest(x, ["sample_id", "dimension"], [F.col(c) for c in ("modified_at", "loaded_at", "category", "intensity", "author")]).select("sample_id", "dimension", "category", "intensity", "author")


@q("page", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 50 offset 100")
def page(spark, d):
    return crud.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 50, 100)


@q("count_rows", "select count(*) as n from lineitem")
def count_rows(spark, d):
    return crud.count_rows(read(spark, d, "lineitem"))


@q("query_strings", "select cast(o_orderkey as varchar) as o_orderkey from orders")
def query_strings(spark, d):
    return crud.strings(read(spark, d, "orders"), "o_orderkey")


@q("truncate_table", "select r_regionkey, r_name from region where false union all select 1, 'ONLY'")
def truncate_table(spark, d):
    return crud.insert_one(table.empty_like(read(spark, d, "region")), r_regionkey=1, r_name="ONLY")


@q("anti_not_processed", "select o_orderkey from orders where (o_orderkey, 'v2') not in (select l_orderkey, case when l_linenumber > 3 then 'v2' else 'v1' end from lineitem)")
def anti_not_processed(spark, d):
    lines = read(spark, d, "lineitem")
    done = lines.select(F.col("l_orderkey").alias("o_orderkey"), to_column("case when l_linenumber > 3 then 'v2' else 'v1' end", lines).alias("version"))
    return read(spark, d, "orders").select("o_orderkey", F.lit("v2").alias("version")).join(done, ["o_orderkey", "version"], "left_anti").select("o_orderkey")


@q("copy_cast_rename", "select cast(p_partkey as varchar) as id, p_name as title, cast(p_size as double) as size from part")
def copy_cast_rename(spark, d):
    p = read(spark, d, "part")
    return p.select(*[to_column(f"cast({old} as {t})", p).alias(new) for old, new, t in (("p_partkey", "id", "text"), ("p_name", "title", "text"), ("p_size", "size", "double"))])
