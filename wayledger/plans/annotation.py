"""Queries of the annotation store and the video labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayledger.operators import labels as L
from wayledger.plans.registry import Catalog
from wayledger.runtime import read, stage

CATALOG = Catalog()
q = CATALOG.query

_S = """
s as (select id, image_path, region_id, region, author, modified_at from (
  select *, row_number() over (partition by id order by modified_at desc nulls last, loaded_at desc nulls last, image_path desc nulls last, region_id desc nulls last, region desc nulls last, author desc nulls last) as n,
    max(loaded_at) over (partition by id) as last_loaded from sample)
  where n = 1 and id not in (select d.id from (select id, max(deleted_at) as gone from sample_delete group by id) d join (select id, max(loaded_at) as loaded from sample group by id) x on x.id = d.id where gone > loaded)),
l as (select sample_id, dimension, category, intensity, author, modified_at from (
  select *, row_number() over (partition by sample_id, dimension order by modified_at desc nulls last, loaded_at desc nulls last, category desc nulls last, intensity desc nulls last, author desc nulls last) as n from (select * replace (case when not isnan(intensity) then intensity end as intensity) from label))
  where n = 1 and trim(category, ' ') <> '')
"""


def _samples(spark, d):
    return L.current_samples(read(spark, d, "sample"), read(spark, d, "sample_delete")).drop("loaded_at")


def _labels(spark, d):
    return L.current_labels(read(spark, d, "label")).drop("loaded_at")


@q("current_samples", f"with {_S} select id, image_path, region_id, region, author, modified_at from s")
def current_samples(spark, d):
    return _samples(spark, d).select("id", "image_path", "region_id", "region", "author", "modified_at")


@q("current_labels", f"with {_S} select sample_id, dimension, category, intensity from l")
def current_labels(spark, d):
    return _labels(spark, d).select("sample_id", "dimension", "category", "intensity")


@q("inner_sample_label", f"with {_S} select image_path, region_id, region, dimension, category, intensity from s join l on l.sample_id = s.id")
def inner_sample_label(spark, d):
    return L.get_labels(_samples(spark, d), _labels(spark, d))


@q("labels_of_dimension", f"with {_S} select image_path, region_id, region, dimension, category, intensity from s join l on l.sample_id = s.id where dimension = 'rut_depth'")
def labels_of_dimension(spark, d):
    return L.get_labels(_samples(spark, d), _labels(spark, d), dimension="rut_depth")


@q(
    "labels_json",
    f"""with {_S}, flat as (select image_path, region_id, region, dimension, category, intensity from s join l on l.sample_id = s.id),
each as (select image_path, region_id, dimension, max(region) as region, first(category order by category desc nulls last, intensity desc nulls last) as category, first(intensity order by category desc nulls last, intensity desc nulls last) as intensity from flat group by all),
body as (select image_path, region_id, max(region) as region, string_agg(to_json(dimension)::varchar || ':{{"category":' || to_json(category)::varchar || coalesce(',"intensity":' || to_json(intensity)::varchar, '') || '}}', ',' order by dimension) as dims from each group by image_path, region_id)
select image_path, region_id, '{{' || case when region <> '' then '"region":' || to_json(region)::varchar || ',' else '' end || '"dims":{{' || dims || '}}}}' as body from body""",
)
def labels_json(spark, d):
    return L.labels_json(L.get_labels(_samples(spark, d), _labels(spark, d)))


@q("folder_summary_prefix", f"with {_S} select distinct image_path from s where starts_with(image_path, 'kromdal/') and id in (select sample_id from l)")
def folder_summary_prefix(spark, d):
    return L.folder_summary(_samples(spark, d), _labels(spark, d), prefix="kromdal/")


@q("folder_summary_dim", f"with {_S} select distinct image_path from s where id in (select sample_id from l where dimension = 'lighting')")
def folder_summary_dim(spark, d):
    return L.folder_summary(_samples(spark, d), _labels(spark, d), dimension="lighting")


@q("folder_summary_all", f"with {_S} select image_path from s join l on l.sample_id = s.id")
def folder_summary_all(spark, d):
    return L.folder_summary(_samples(spark, d), _labels(spark, d), distinct=False)


@q("label_report", f"with {_S} select dimension, category, count(*) as n from l group by all")
def label_report(spark, d):
    return L.label_report(_labels(spark, d))


@q("author_report", f"with {_S} select coalesce(author, '') as author, count(*) as n from l group by all")
def author_report(spark, d):
    return L.author_report(_labels(spark, d))


@q(
    "report_json",
    f"""with {_S}, n as (select dimension, category, count(*) as n from l group by all), d as (select dimension, string_agg(to_json(category)::varchar || ':{{"count":' || n || '}}', ',' order by category) as c from n group by dimension),
a as (select coalesce(author, '') as author, count(*) as n from l group by all)
select '{{"dimensions":{{' || (select string_agg(to_json(dimension)::varchar || ':{{' || c || '}}', ',' order by dimension) from d) || '}},"authors":{{' || (select string_agg(to_json(author)::varchar || ':{{"count":' || n || '}}', ',' order by author) from a) || '}}}}' as report""",
)
def report_json(spark, d):
    return L.report_json(_labels(spark, d))


@q("next_region_id", f"with {_S} select image_path, coalesce(max(region_id), 0) + 1 as next_region_id from s group by image_path")
def next_region_id(spark, d):
    return L.next_region_id(_samples(spark, d))


@q("duplicate_regions", f"with {_S} select image_path, region_id, count(*) as n from s group by all having n > 1")
def duplicate_regions(spark, d):
    return L.duplicate_regions(_samples(spark, d))


_POINTS = r"""
p as (select *, list_transform(string_split(nullif(regexp_extract(region, '^\s*\[\s*\[\s*\[([-+0-9.eE,\s]*)\]\s*\]\s*\]\s*$', 1), ''), ','), lambda x: try_cast(trim(x) as double)) as v from s),
r as (select *, [v[i] for i in range(1, len(v), 2)] as xs, [v[i] for i in range(2, len(v) + 1, 2)] as ys from p where len(v) >= 6 and len(v) % 2 = 0 and not list_contains(list_transform(v, lambda x: x is null), true)),
b as (select *, list_min(xs) as x1, list_min(ys) as y1, list_max(xs) as x2, list_max(ys) as y2,
  len(xs) = 4 and list_bool_and([(xs[i] <> xs[i % 4 + 1]) <> (ys[i] <> ys[i % 4 + 1]) for i in range(1, 5)]) as is_rectangle from r)
"""


@q("region_decode", f"with {_S}, {_POINTS} select id, len(xs) as n, x1, y1, x2, y2, is_rectangle from b")
def region_decode(spark, d):
    p = _samples(spark, d).select("id", L.region_points("region").alias("p")).where("p is not null")
    b = L.region_bounds(F.col("p"))
    return p.select("id", F.size("p").cast("bigint").alias("n"), b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"), L.is_rectangle(F.col("p")).alias("is_rectangle"))


@q("rect_check", f"with {_S}, {_POINTS} select id from b where is_rectangle and (x1 < 0 or y1 < 0 or x2 > 1500 or y2 > 900)")
def rect_check(spark, d):
    s = _samples(spark, d)
    images = s.select("image_path").distinct().select("image_path", F.lit(1500).alias("width"), F.lit(900).alias("height"))
    return L.outside_image(s, images).select("id")


# commands of every mode, made from the store itself
_COMMANDS = """
c as (
  select image_path as image, region_id, '' as region, 'rut_depth' as dimension, '' as category, null::double as intensity, 'tester' as author from s where region_id <> 0 and id % 4 = 0 and image_path in (select image_path from s group by image_path having count(*) = count(distinct region_id))
  union all select image_path, region_id, '[[[1,1,9,1,9,9]]]', 'rut_depth', '3', 1.5, 'tester' from s where region_id <> 0 and id % 4 = 1 and image_path in (select image_path from s group by image_path having count(*) = count(distinct region_id))
  union all select distinct image_path, 0, '', 'lighting', 'night', null::double, 'tester' from s where id % 4 = 2 and image_path in (select image_path from s group by image_path having count(*) = count(distinct region_id))
  union all select image_path, 0, '[[[2,2,8,2,8,8]]]', 'lighting', 'day', 0.5, 'tester' from s where region_id = 1 and id % 4 = 3 and image_path in (select image_path from s group by image_path having count(*) = count(distinct region_id)))
"""


def _commands(s):
    clean = s.groupBy("image_path").agg(F.count("*").alias("n"), F.count_distinct("region_id").alias("m")).where("n = m").select("image_path")
    s = s.join(clean, "image_path", "left_semi")

    def part(condition, region_id, region, dimension, category, intensity):
        return s.where(condition).select(F.col("image_path").alias("image"), region_id.alias("region_id"), F.lit(region).alias("region"), F.lit(dimension).alias("dimension"), F.lit(category).alias("category"), F.lit(intensity).cast("double").alias("intensity"), F.lit("tester").alias("author"), F.lit("2024-07-01 00:00:00").cast("timestamp_ntz").alias("modified_at"))

    zero = F.lit(0).cast("bigint")
    return (
        part("region_id <> 0 and id % 4 = 0", F.col("region_id"), "", "rut_depth", "", None)
        .unionByName(part("region_id <> 0 and id % 4 = 1", F.col("region_id"), "[[[1,1,9,1,9,9]]]", "rut_depth", "3", 1.5))
        .unionByName(part("id % 4 = 2", zero, "", "lighting", "night", None).distinct())
        .unionByName(part("region_id = 1 and id % 4 = 3", zero, "[[[2,2,8,2,8,8]]]", "lighting", "day", 0.5))
    )


@q("command_modes", f"with {_S}, {_COMMANDS} select case when region_id <> 0 and region = '' then 'delete' when region_id <> 0 then 'update' when region <> '' then 'create' else 'whole image' end as mode, count(*) as n from c group by all")
def command_modes(spark, d):
    return _commands(_samples(spark, d)).groupBy(L.region_mode(F.col("region_id"), F.col("region")).alias("mode")).agg(F.count("*").alias("n"))


_AFTER = f"""
with {_S}, {_COMMANDS},
gone as (select s.id from c join s on s.image_path = c.image and s.region_id = c.region_id where c.region_id <> 0 and c.region = ''),
created as (select image, (select coalesce(max(region_id), 0) from s where s.image_path = c.image) + row_number() over (partition by image order by region, dimension) as region_id, region, dimension, category, intensity from c where region_id = 0 and region <> ''),
whole as (select image from c where region_id = 0 and region = '' and not exists (select 1 from s where s.image_path = c.image and s.region_id = 0))
"""


@q(
    "set_label_samples",
    _AFTER
    + """select s.image_path, s.region_id, coalesce(u.region, s.region) as region from s left join c u on u.image = s.image_path and u.region_id = s.region_id and u.region_id <> 0 and u.region <> '' where s.id not in (select id from gone)
  union all select image, region_id, region from created union all select image, 0, null from whole""",
)
def set_label_samples(spark, d):
    s = stage(_samples(spark, d), "samples")
    after, _ = L.set_labels(s, stage(_labels(spark, d), "labels"), _commands(s))
    return after.select("image_path", "region_id", "region")


@q(
    "set_label_labels",
    _AFTER
    + """, edit as (
  select s.id, c.image, c.region_id, c.dimension, c.category, c.intensity from c left join s on s.image_path = c.image and s.region_id = c.region_id where not (c.region_id = 0 and c.region <> '') and not (c.region_id <> 0 and c.region = '')
  union all select null, image, region_id, dimension, category, intensity from created)
select s.image_path, s.region_id, l.dimension, l.category, l.intensity from l left join s on s.id = l.sample_id where l.sample_id not in (select id from gone) and not exists (select 1 from edit where edit.id = l.sample_id and edit.dimension = l.dimension) and s.id is not null
union all select image, region_id, dimension, category, intensity from edit where category <> ''""",
)
def set_label_labels(spark, d):
    s = stage(_samples(spark, d), "samples")
    after, labels = L.set_labels(s, stage(_labels(spark, d), "labels"), _commands(s))
    named = after.select(F.col("id").alias("sample_id"), "image_path", "region_id")
    return labels.join(named, "sample_id").select("image_path", "region_id", "dimension", "category", "intensity")


@q(
    "merge_stores",
    f"""with {_S}, src as (select distinct 'other/' || n_name || '.jpg' as image_path, 'lighting' as dimension, 'day' as category from nation union all select distinct image_path, 'lighting', 'night' from s where region_id = 0 and id % 10 = 0),
whole as (select image_path, min(id) as id from s where region_id = 0 group by all)
select w.image_path, 'lighting' as dimension, src.category from src join whole w using (image_path)
union all select image_path, dimension, category from src where image_path not in (select image_path from whole)
union all select s.image_path, l.dimension, l.category from l join s on s.id = l.sample_id where not (l.dimension = 'lighting' and l.sample_id in (select w.id from whole w join src using (image_path)))""",
)
def merge_stores(spark, d):
    s = stage(_samples(spark, d), "samples")
    row = lambda df, path, category: df.select(path.alias("image_path"), F.lit("lighting").alias("dimension"), F.lit(category).alias("category"), F.lit("x").alias("author"), F.lit(None).cast("timestamp_ntz").alias("modified_at")).distinct()
    source = row(read(spark, d, "nation"), F.concat(F.lit("other/"), "n_name", F.lit(".jpg")), "day").unionByName(row(s.where("region_id = 0 and id % 10 = 0"), F.col("image_path"), "night"))
    every, labels = L.merge_stores(s, stage(_labels(spark, d), "labels"), source)
    return labels.join(every.select(F.col("id").alias("sample_id"), "image_path"), "sample_id").select("image_path", "dimension", "category")


@q(
    "export_plan",
    rf"""with {_S}, f as (select image_path, dimension, category, regexp_extract(image_path, '([^/\\]*)$', 1) as name from s join l on l.sample_id = s.id)
select '/photos/' || image_path as source, '/train/' || dimension || '/' || category || '/' || regexp_replace(name, '\.[^.]*$', '') || '_' || substring(md5(image_path), 1, 16) || regexp_extract(name, '(\.[^.]*)$', 1) as target from f""",
)
def export_plan(spark, d):
    return L.export_plan(L.get_labels(_samples(spark, d), _labels(spark, d)), "/photos", "/train")


# --- video labels ---------------------------------------------------------------------------------------------


@q("crop_plan", "select distinct video, frame_us, class_name, least(x1, x2) - 8 as left, least(y1, y2) - 8 as top, abs(x1 - x2) + 16 as width, abs(y1 - y2) + 16 as height from frame_label where x1 is not null and x2 is not null and y1 is not null and y2 is not null")
def crop_plan(spark, d):
    return L.crop_plan(read(spark, d, "frame_label"), 8)


_FRAMES = "f as (select distinct * from frame_label)"
_GROUPS = [("map crack", "crack"), ("cross split", "crack"), ("block split", "crack"), ("curb stone", "kerb")]
_GROUP_SQL = "g(class_name, grp) as (values " + ", ".join(f"('{c}', '{g}')" for c, g in _GROUPS) + ")"


@q("frame_rows", "select video, frame_us, class_name, count(*) as n from (select distinct * from frame_label) group by all")
def frame_rows(spark, d):
    return L.flatten(L.frames(read(spark, d, "frame_label"))).groupBy("video", "frame_us", "class_name").agg(F.count("*").alias("n"))


@q("class_counts", f"with {_FRAMES} select class_name, count(*) as n from f group by all")
def class_counts(spark, d):
    return L.class_counts(read(spark, d, "frame_label").distinct())


@q("class_counts_grouped", f"with {_FRAMES}, {_GROUP_SQL} select coalesce(grp, 'UNGROUPED:' || class_name) as \"group\", count(*) as n from f left join g using (class_name) group by all")
def class_counts_grouped(spark, d):
    groups = spark.createDataFrame(_GROUPS, "class_name string, group string")
    return L.class_counts(read(spark, d, "frame_label").distinct(), groups)


@q("distinct_classes", "select distinct class_name from frame_label order by class_name")
def distinct_classes(spark, d):
    return read(spark, d, "frame_label").select("class_name").distinct().orderBy("class_name")


@q("class_index", 'select class_name, row_number() over (order by class_name) - 1 as "index" from (select distinct class_name from frame_label where class_name is not null)')
def class_index(spark, d):
    return L.class_index(read(spark, d, "frame_label"))


@q("frames_with_polygon", f"with {_FRAMES} select sum(n)::bigint as n_labels, sum(p)::bigint as n_polygon_frames from (select count(*) as n, max(case when len(string_split(poly, ',')) >= 6 then 1 else 0 end) as p from f group by video, frame_us)")
def frames_with_polygon(spark, d):
    return L.frame_totals(read(spark, d, "frame_label").distinct())


@q("max_edit_time", "select video, frame_us, epoch_us(coalesce(max(to_timestamp(edittime)), timestamptz '2000-01-01 00:00:00+00')) // 1000000 as edited from frame_label group by all")
def max_edit_time(spark, d):
    return L.max_edit_time(read(spark, d, "frame_label")).select("video", "frame_us", F.unix_seconds("edited_at").alias("edited"))


_TWO = """
t as (select * from f where hash_a % 3 <> 0), u as (select * from f where hash_a % 3 <> 1),
tt as (select video, frame_us, coalesce(max(edittime), 946684800) as e from t group by all), ut as (select video, frame_us, coalesce(max(edittime), 946684800) as e from u group by all),
newer as (select ut.video, ut.frame_us from ut left join tt using (video, frame_us) where ut.e > coalesce(tt.e, 946684800))
"""


@q(
    "merge_newer_wins",
    f"""with f as (select distinct *, coalesce(x1, 0) + coalesce(severity, 0) as hash_a from frame_label), {_TWO}
select video, frame_us, class_name, 'target' as origin from t where (video, frame_us) not in (select video, frame_us from newer)
union all select video, frame_us, class_name, 'source' from u where (video, frame_us) in (select video, frame_us from newer)""",
)
def merge_newer_wins(spark, d):
    f = read(spark, d, "frame_label").distinct().withColumn("a", F.coalesce("x1", F.lit(0)) + F.coalesce("severity", F.lit(0)))
    return L.merge_frames(f.where("a % 3 <> 0"), f.where("a % 3 <> 1")).select("video", "frame_us", "class_name", "origin")


@q("merge_replaced", f"with f as (select distinct *, coalesce(x1, 0) + coalesce(severity, 0) as hash_a from frame_label), {_TWO} select count(*) as n from newer")
def merge_replaced(spark, d):
    f = read(spark, d, "frame_label").distinct().withColumn("a", F.coalesce("x1", F.lit(0)) + F.coalesce("severity", F.lit(0)))
    return L.newer_frames(f.where("a % 3 <> 0"), f.where("a % 3 <> 1")).agg(F.count("*").alias("n"))


@q("find_frames", """with f as (select distinct video, frame_us from frame_label), w as (select video, frame_us from f union select video, frame_us + 1000 from f)
select w.video, w.frame_us, bool_or(coalesce(f.frame_us = w.frame_us, false)) as found, count(*) filter (where f.frame_us < w.frame_us) as position from w left join f on f.video = w.video and f.frame_us <= w.frame_us group by all""")
def find_frames(spark, d):
    f = read(spark, d, "frame_label").select("video", "frame_us")
    return L.find_frames(f, f.unionByName(f.withColumn("frame_us", F.col("frame_us") + 1000)))


@q("set_label_turns")
def set_label_turns(spark, d):
    """(image_path, region_id, dimension, category, intensity) after commands on every sample, also those that claim a region twice: several in turn on each."""
    s = stage(_samples(spark, d), "samples")
    command = lambda n, region_id, region, dimension, category: s.where("image_path <> ''").select(F.col("image_path").alias("image"), region_id.alias("region_id"), F.lit(region).alias("region"), F.lit(dimension).alias("dimension"), F.lit(category).alias("category"), F.lit(None).cast("double").alias("intensity"), F.lit("tester").alias("author"), (F.lit("2024-07-01 00:00:00").cast("timestamp_ntz") + F.make_interval(secs=F.lit(n))).alias("modified_at"))
    own, zero = F.col("region_id"), F.lit(0).cast("bigint")
    turns = [command(1, own, "[[[1,1,9,1,9,9]]]", "rut_depth", "3"), command(2, zero, "", "lighting", "night").distinct(), command(3, zero, "[[[2,2,8,2,8,8]]]", "lighting", "day").distinct(), command(4, own, "", "rut_depth", ""), command(5, own, "[[[1,1,9,1,9,9]]]", "rut_depth", "4")]
    after, labels = L.set_labels(s, stage(_labels(spark, d), "labels"), reduce(DataFrame.unionByName, turns).where("region_id is not null"))
    return labels.join(after.select(F.col("id").alias("sample_id"), "image_path", "region_id"), "sample_id").drop("sample_id", "author", "modified_at")


@q("label_predicates", f"with {_FRAMES} select video, frame_us, bool_or(class_name = 'map crack') as has, count(*) filter (where class_name <> 'map crack') as others, bool_or(x1 = 1327 and y1 = 602 and x2 = 1542 and y2 = 676) is true as found from f group by all")
def label_predicates(spark, d):
    f = L.frames(read(spark, d, "frame_label"))
    return f.select("video", "frame_us", L.has_class(F.col("labels"), "map crack").alias("has"), F.size(L.without_class(F.col("labels"), "map crack")).cast("bigint").alias("others"), (L.find_rect(F.col("labels"), 1327, 602, 1542, 676) >= 0).alias("found"))


@q("severity_of_class", f"with {_FRAMES}, x as (select video, frame_us, class_name, severity, labeler, edittime, case when x1 <> x2 then [x1, y1, x2, y2] end as rect, list_transform(string_split(poly, ','), lambda v: v::int) as p from f), y as (select *, row_number() over (partition by video, frame_us order by severity nulls first, labeler nulls first, edittime nulls first, rect nulls first, p nulls first) as n from x where class_name = 'map crack') select f.video, f.frame_us, coalesce(max(y.severity), -1) as severity from (select distinct video, frame_us from f) f left join y on y.video = f.video and y.frame_us = f.frame_us and n = 1 group by all")
def severity_of_class(spark, d):
    f = L.frames(read(spark, d, "frame_label"))
    first = F.transform(F.col("labels"), lambda x: x)
    by_severity = F.array_sort(first, lambda a, b: F.when(a["severity"].isNull() & b["severity"].isNull(), 0).when(a["severity"].isNull(), -1).when(b["severity"].isNull(), 1).when(a["severity"] < b["severity"], -1).when(a["severity"] > b["severity"], 1).otherwise(0))
    return f.select("video", "frame_us", L.severity_of(by_severity, "map crack").alias("severity"))


@q("set_class", f"with {_FRAMES} select video, frame_us, count(*) filter (where class_name <> 'map crack') + 1 as n from f group by all")
def set_class(spark, d):
    f = L.frames(read(spark, d, "frame_label"))
    changed = L.with_class(F.col("labels"), "map crack", 4, "tester", 1_700_000_000, F.col("labels")[0])
    return f.select("video", "frame_us", F.size(changed).cast("bigint").alias("n"))


@q("empty_frames", f"with {_FRAMES} select video, frame_us from f group by all having count(*) filter (where class_name <> 'curb stone') > 0")
def empty_frames(spark, d):
    f = L.frames(read(spark, d, "frame_label"))
    return L.remove_empty_frames(f.withColumn("labels", L.without_class(F.col("labels"), "curb stone"))).select("video", "frame_us")


@q("merge_polygons", f"with f as (select distinct *, poly is not null and len(string_split(poly, ',')) >= 6 as is_poly from frame_label), t as (select * from f where coalesce(severity, 0) < 3), u as (select * from f where coalesce(severity, 0) >= 3) select video, frame_us, count(*) as n from (select video, frame_us from t union all select video, frame_us from u where is_poly or (video, frame_us) not in (select video, frame_us from t)) group by all")
def merge_polygons(spark, d):
    rows = read(spark, d, "frame_label")
    split = F.coalesce("severity", F.lit(0))
    merged = L.merge_polygons(L.frames(rows.where(split < 3)), L.frames(rows.where(split >= 3)))
    return merged.select("video", "frame_us", F.size("labels").cast("bigint").alias("n"))


@q("edit_heat", "select distinct video, frame_us, edittime, least(greatest(1 - (1618000000 - edittime) / 300.0, 0), 1)::double as heat from frame_label where edittime is not null")
def edit_heat(spark, d):
    return read(spark, d, "frame_label").where("edittime is not null").select("video", "frame_us", "edittime", L.edit_heat(F.col("edittime"), 1618000000).alias("heat")).distinct()


_TAXONOMY = "x as (select row_number() over (order by dimension, label) as key, dimension as \"group\", dimension || ':' || label as class_name, has_intensity as has_severity, dimension < 'l' as is_polygon from dimension_def)"


def _taxonomy(spark, d):
    x = read(spark, d, "dimension_def")  # a fixed table of a few hundred rows
    return x.select(F.row_number().over(W.orderBy("dimension", "label")).alias("key"), F.col("dimension").alias("group"), F.concat_ws(":", "dimension", "label").alias("class_name"), F.col("has_intensity").alias("has_severity"), (F.col("dimension") < "l").alias("is_polygon"))


@q("taxonomy_indexes", f"with {_TAXONOMY} select key, class_name, is_polygon, case when not is_polygon then row_number() over (partition by is_polygon order by key) - 1 end as patch_index, case when is_polygon then row_number() over (partition by is_polygon order by key) end as segmentation_index from x")
def taxonomy_indexes(spark, d):
    return L.taxonomy_indexes(_taxonomy(spark, d))


@q("taxonomy_runs", f"with {_TAXONOMY}, y as (select *, case when key % 5 = 0 then 'other' else \"group\" end as g from x), z as (select *, case when g = lag(g) over (order by key) then 0 else 1 end as fresh from y), r as (select *, sum(fresh) over (order by key) - 1 as run from z) select run::bigint as run, g as \"group\", min(key) as first_key, count(*) as n_classes from r group by all")
def taxonomy_runs(spark, d):
    x = _taxonomy(spark, d).withColumn("group", F.when(F.col("key") % 5 == 0, "other").otherwise(F.col("group")))
    return L.taxonomy_runs(x)


@q("taxonomy_json", f"with {_TAXONOMY} select \"group\", '[' || string_agg('{{\"class\":\"' || class_name || '\",\"has_severity\":' || has_severity || ',\"is_polygon\":' || is_polygon || '}}', ',' order by key) || ']' as classes from x group by all")
def taxonomy_json(spark, d):
    return L.taxonomy_json(_taxonomy(spark, d))


@q("model_metadata", "select r_name as part, 'v' || r_regionkey as version, array_to_string(list(n_name order by n_nationkey), '|') as names, string_agg('v' || r_regionkey, '-') as all_versions from nation join region on r_regionkey = n_regionkey group by r_name, r_regionkey")
def model_metadata(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    m = n.groupBy(F.col("r_name").alias("part"), F.concat(F.lit("v"), F.col("r_regionkey").cast("string")).alias("version")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("categories"))
    named = L.category_names(m)
    return named.select("part", "version", F.array_join("names", "|").alias("names"), F.array_join(F.transform("names", lambda _: F.col("version")), "-").alias("all_versions"))
