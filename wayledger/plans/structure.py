"""Queries of sources, schemas, stamps and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayledger.functions import wkt
from wayledger.operators import stamps
from wayledger.plans import schema
from wayledger.plans.registry import Catalog
from wayledger.runtime import read
from wayledger.sources import flat, tracks
from wayledger.sources.labelfiles import not_analysed, parse_photos
from wayledger.streaming import jobs

CATALOG = Catalog()
q = CATALOG.query


_INT, _DBL = r"'^[+-]?\d{1,18}$'", r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def _mask_sql(c):
    return f"coalesce(bit_or(case when coalesce({c}::varchar, '') = '' then 0 when regexp_matches({c}::varchar, {_INT}) then 1 when regexp_matches({c}::varchar, {_DBL}) then 2 else 64 end), 0)::int as {c}"


@q("csv_type_masks", f"select {', '.join(map(_mask_sql, ('p_partkey', 'p_name', 'p_brand', 'p_size', 'p_retailprice')))} from part")
def csv_type_masks(spark, d):
    p = read(spark, d, "part")
    return flat.column_masks(p.select(*[F.col(c).cast("string").alias(c) for c in ("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")]))


@q("csv_cells", "select doc_id, case when regexp_matches(title, '[,\"\r\n]') then '\"' || replace(title, '\"', '\"\"') || '\"' else title end as cell from documents")
def csv_cells(spark, d):
    return read(spark, d, "documents").select("doc_id", flat.encode_cell(F.col("title")).alias("cell"))


@q("row_ids", "select row_number() over (order by c_mktsegment, c_custkey) as rowid, c_custkey as id, c_acctbal::varchar is not null as ok from customer")
def row_ids(spark, d):
    c = flat.with_row_id(read(spark, d, "customer"), ["c_mktsegment", "c_custkey"])
    return flat.copy_table(c, {"rowid": "rowid", "c_custkey": "id"}).withColumn("ok", F.lit(True))


@q("positions_csv", "select printf('%.6f,%.6f,%.3f', lon, lat, dt) as line from track_point where lon is not null and lat is not null and dt is not null")
def positions_csv(spark, d):
    return tracks.positions_csv(read(spark, d, "track_point").where("lon is not null and lat is not null and dt is not null"))


@q("speeds_csv", "select printf('%.3f,%.1f', dt, speed) as line from track_point where speed is not null and dt is not null")
def speeds_csv(spark, d):
    return tracks.speeds_csv(read(spark, d, "track_point").where("speed is not null and dt is not null"), "dt")


@q(
    "sections_geojson",
    """with t as (select track_id, dt, first(lon order by lon, lat) as lon, first(lat order by lon, lat) as lat from track_point where dt is not null and track_id is not null and lon <> 0 and lat is not null group by track_id, dt),
n as (select *, row_number() over (partition by track_id order by dt) - 1 as i from t), x as (select track_id, dt, lon, lat, i // 20 as section from n union all select track_id, dt, lon, lat, i // 20 - 1 from n where i % 20 = 0 and i > 0)
select track_id, section, '{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[' || string_agg('[' || lon || ',' || lat || ']', ',' order by dt) || ']}}' as feature from x group by track_id, section""",
)
def sections_geojson(spark, d):
    """Sections of the tracks with one point a time, the least of those that share it."""
    points = read(spark, d, "track_point").where("dt is not null and track_id is not null and lon <> 0 and lat is not null")
    return tracks.sections_geojson(points.groupBy("track_id", "dt").agg(F.min(F.struct("lon", "lat")).alias("p")).select("track_id", "dt", "p.lon", "p.lat"))


@q("point_wkt", "select distinct track_id, dt, printf('POINT(%.6f %.6f)', lon, lat) as wkt from track_point where lon is not null and lat is not null")
def point_wkt(spark, d):
    return read(spark, d, "track_point").where("lon is not null and lat is not null").select("track_id", "dt", wkt.geom_point_text(F.col("lon"), F.col("lat")).alias("wkt")).distinct()


def _polygons(spark, d):
    """(id, region, wkt) of the regions that are polygons, in as many partitions as shuffles have, for work in Python."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = read(spark, d, "sample").select("id", "region").repartition(parts, "id", "region").distinct()
    return distinct.withColumn("wkt", _polygon_text()).where("wkt is not null")


def _polygon_text():
    numbers = F.regexp_extract("region", r"^\s*\[\s*\[\s*\[([-+0-9.eE,\s]*)\]\s*\]\s*\]\s*$", 1)
    n = F.split(numbers, ",")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda i: F.concat_ws(" ", n[2 * i], n[2 * i + 1]))
    return F.when((F.size(n) >= 6) & (F.size(n) % 2 == 0), F.concat(F.lit("POLYGON(("), F.array_join(pairs, ", "), F.lit(", "), pairs[0], F.lit("))")))


@q("wkt_area", r"with p as (select distinct id, region, string_split(nullif(regexp_extract(region, '^\s*\[\s*\[\s*\[([-+0-9.eE,\s]*)\]\s*\]\s*\]\s*$', 1), ''), ',')::double[] as v from sample), e as (select id, region, v, unnest(range(1, len(v) // 2 + 1)) as i from p where len(v) >= 6 and len(v) % 2 = 0) select id, region, round(abs(sum(v[2*i-1] * v[(2*i+1-1) % len(v) + 2] - v[(2*i+1-1) % len(v) + 1] * v[2*i])) / 2, 4) as area from e group by all")
def wkt_area(spark, d):
    g = _polygons(spark, d)
    return g.withColumn("g", wkt.geom_from_wkt("wkt")).select("id", "region", F.round(wkt.geom_area(F.col("g")), 4).alias("area"))


@q("wkb_roundtrip", r"select count(*) as n, true as same from (select distinct id, region from sample where len(string_split(nullif(regexp_extract(region, '^\s*\[\s*\[\s*\[([-+0-9.eE,\s]*)\]\s*\]\s*\]\s*$', 1), ''), ',')) >= 6)")
def wkb_roundtrip(spark, d):
    g = _polygons(spark, d)
    g = g.withColumn("a", wkt.geom_from_wkt("wkt")).withColumn("b", wkt.geom_from_wkb(wkt.geom_to_wkb("a"))).withColumn("c", wkt.geom_from_json(wkt.geom_to_json("a")))
    return g.agg(F.count("*").alias("n"), F.bool_and(wkt.geom_to_wkt("a") == wkt.geom_to_wkt("b")).alias("same"))


@q("coarse_intersect", r"with p as (select distinct id, region, string_split(nullif(regexp_extract(region, '^\s*\[\s*\[\s*\[([-+0-9.eE,\s]*)\]\s*\]\s*\]\s*$', 1), ''), ',')::double[] as v from sample) select id, region, list_min([v[i] for i in range(1, len(v), 2)]) <= 900 and list_max([v[i] for i in range(1, len(v), 2)]) >= 500 and list_min([v[i] for i in range(2, len(v) + 1, 2)]) <= 600 and list_max([v[i] for i in range(2, len(v) + 1, 2)]) >= 300 as hit from p where len(v) >= 6 and len(v) % 2 = 0")
def coarse_intersect(spark, d):
    g = _polygons(spark, d).withColumn("g", wkt.geom_from_wkt("wkt"))
    return g.select("id", "region", wkt.geom_intersects_box(F.col("g"), 500, 300, 900, 600).alias("hit"))


@q("schema_diff_fields", "select * from (values ('create', 's_phone', null, 'string'), ('drop', 's_acctbal', 'double', null), ('change', 's_nationkey', 'int', 'bigint')) t(change, field, old_type, new_type)")
def schema_diff_fields(spark, d):
    s = read(spark, d, "supplier")
    return schema.field_diff(s, s.drop("s_acctbal").withColumn("s_phone", F.lit("")).withColumn("s_nationkey", F.col("s_nationkey").cast("bigint")))


_ID = "1f0c6a52-0000-4000-8000-000000000001"
_TRACKED = "t as (select o_orderpriority as tablename, count(*) % 3 as createcount, count(*) as stamp from orders group by 1)"


def _tracked(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tablename")).agg((F.count("*") % 3).alias("createcount"), F.count("*").alias("stamp"))


@q("table_stamps", f"with {_TRACKED}, w as (select tablename from t union select 'absent') select w.tablename, coalesce(md5('{_ID}|' || t.tablename || '|' || createcount || '|' || stamp), repeat('0', 32)) as signature from w left join t using (tablename)")
def table_stamps(spark, d):
    t = _tracked(spark, d)
    return stamps.table_stamps(t, _ID, t.select("tablename").unionByName(spark.createDataFrame([("absent",)], "tablename string")))


@q("stamp_increment", f"with {_TRACKED}, c as (select o_orderpriority as tablename from orders where o_orderkey < 5 union select 'fresh') select coalesce(t.tablename, c.tablename) as tablename, coalesce(createcount, 0) as createcount, coalesce(stamp, 0) + case when c.tablename is null then 0 else 1 end as stamp from t full join c on t.tablename = c.tablename")
def stamp_increment(spark, d):
    changed = read(spark, d, "orders").where("o_orderkey < 5").select(F.col("o_orderpriority").alias("tablename")).unionByName(spark.createDataFrame([("fresh",)], "tablename string"))
    return stamps.increment(_tracked(spark, d), changed)


@q("stamp_combined", f"with {_TRACKED} select md5(string_agg(tablename || '=' || md5('{_ID}|' || tablename || '|' || createcount || '|' || stamp), ',' order by tablename || '=' || md5('{_ID}|' || tablename || '|' || createcount || '|' || stamp))) as signature from t")
def stamp_combined(spark, d):
    return stamps.combined(stamps.table_stamps(_tracked(spark, d), _ID))


@q("union_stamps", f"with {_TRACKED} select 0 as kind, '{_ID}' as name, 0::bigint as createcount, 0::bigint as stamp union select 1, tablename, createcount, stamp from t")
def union_stamps(spark, d):
    return stamps.union_stamps(spark.createDataFrame([(_ID,), (_ID,)], "identity string"), _tracked(spark, d))


@q("session_gap", "with g as (select user_id, ts, case when ts - lag(ts) over w <= interval 3600 seconds then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as n from s group by user_id, k")
def session_gap(spark, d):
    return jobs.sessions(read(spark, d, "events"), "user_id", "ts", 3600)


@q("dirty_dedupe", "select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def dirty_dedupe(spark, d):
    e = read(spark, d, "events")
    return jobs.last_edits(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "value")


@q("photo_list", "select 'http://x/' || event_id as url, (props->>'$.k')::int % 2 = 0 as todo from events")
def photo_list(spark, d):
    version = F.concat(F.lit("v"), (F.get_json_object("props", "$.k").cast("int") % 2).cast("string"))
    text = F.concat(F.lit('[{"Photo": {"URL": "http://x/'), F.col("event_id").cast("string"), F.lit('"}, "Analysis": {"Models": {"tar": {"Version": "'), version, F.lit('", "Count": {"crack": 2}}}}}]'))
    photos = parse_photos(read(spark, d, "events").select(text.alias("body")), "body")
    todo = not_analysed(photos, "tar", "v1").select("url", F.lit(True).alias("todo"))
    return photos.select("url").join(todo, "url", "left").select("url", F.coalesce("todo", F.lit(False)).alias("todo"))


@q("photo_analysis", "select p_name as url, 'letters' as model, 'v1' as version, strlen(p_name)::int as length from part")
def photo_analysis(spark, d):
    photos = read(spark, d, "part").select(F.col("p_name").alias("url"))
    found = jobs.analysis_pipeline(photos, lambda u: u.encode(), {"letters": lambda batch: [{"length": len(x)} for x in batch]}, "v1")
    return found.select("url", "model", "version", F.col("counts")["length"].alias("length"))
