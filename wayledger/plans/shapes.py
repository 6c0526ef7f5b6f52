"""Queries of geometry, curves, projections, tiles and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayledger.functions import geometry as G
from wayledger.operators import raster as R
from wayledger.operators.labels import region_points
from wayledger.plans.registry import Catalog
from wayledger.runtime import read

CATALOG = Catalog()
q = CATALOG.query

_E = "e as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as a, embedding[4]::double as b, embedding[5]::double as c, embedding[6]::double as d from embeddings)"


def _e(spark, d):
    return read(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyabcd")])


def _round(c, digits=6):
    return F.round(c, digits)


@q("distance", f"with {_E} select vec_id, round(sqrt(pow(x - a, 2) + pow(y - b, 2)), 6) as distance from e")
def distance(spark, d):
    return _e(spark, d).select("vec_id", _round(G.distance(G.point(F.col("x"), F.col("y")), G.point(F.col("a"), F.col("b")))).alias("distance"))


@q("closest_on_segment", f"with {_E}, m as (select *, greatest(least(((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) * (c - a) + (d - b) * (d - b)), 1), 0) as mu from e) select vec_id, round(a + mu * (c - a), 6) as px, round(b + mu * (d - b), 6) as py, round(mu, 6) as mu, sign(round((c - a) * (y - b) - (d - b) * (x - a), 9))::int as side from m")
def closest_on_segment(spark, d):
    c = [F.col(n) for n in "xyabcd"]
    p = G.closest_point(*c)
    return _e(spark, d).select("vec_id", _round(p["x"]).alias("px"), _round(p["y"]).alias("py"), _round(p["mu"]).alias("mu"), F.signum(F.round(G.side_of_line(*c), 9)).cast("int").alias("side"))


_RING = r"""
s as (select distinct id, region from sample),
p as (select id, region, list_transform(string_split(nullif(regexp_extract(region, '^\s*\[\s*\[\s*\[([-+0-9.eE,\s]*)\]\s*\]\s*\]\s*$', 1), ''), ','), lambda v: try_cast(trim(v) as double)) as v from s),
r as (select id, region, [v[i] for i in range(1, len(v), 2)] as xs, [v[i] for i in range(2, len(v) + 1, 2)] as ys from p where len(v) >= 6 and len(v) % 2 = 0 and not list_contains(list_transform(v, lambda u: u is null), true)),
edge as (select id, region, unnest(range(1, len(xs) + 1)) as i, xs, ys from r),
g as (select id, region, i, len(xs) as n, xs[i] as ax, ys[i] as ay, xs[i % len(xs) + 1] as qx, ys[i % len(xs) + 1] as qy from edge)
"""


def _rings(spark, d):
    return read(spark, d, "sample").select("id", "region").distinct().withColumn("ring", region_points("region")).where("ring is not null")


@q("poly_area", f"with {_RING} select id, region, round(sum(ax * qy - qx * ay) / 2, 4) as area from g group by all")
def poly_area(spark, d):
    return _rings(spark, d).select("id", "region", F.round(G.signed_area(F.col("ring")), 4).alias("area"))


@q("poly_orientation", f"with {_RING}, a as (select id, region, sum(ax * qy - qx * ay) as a from g group by all) select id, region, case when a > 0 then 'ccw' when a < 0 then 'cw' else 'invalid' end as orientation from a")
def poly_orientation(spark, d):
    return _rings(spark, d).select("id", "region", G.orientation(F.col("ring")).alias("orientation"))


@q("pt_in_poly", f"with {_RING} select id, region, sum(case when (ay > 400.5) <> (qy > 400.5) and 800.5 < ax + (400.5 - ay) / (qy - ay) * (qx - ax) then 1 else 0 end) % 2 = 1 as inside from g group by all")
def pt_in_poly(spark, d):
    return _rings(spark, d).select("id", "region", G.inside(F.lit(800.5), F.lit(400.5), F.array("ring")).alias("inside"))


@q("snap_polyline", f"with {_RING}, m as (select *, greatest(least(((500 - ax) * (qx - ax) + (300 - ay) * (qy - ay)) / nullif((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay), 0), 1), 0) as mu from g where i < n), k as (select id, region, sqrt(pow(ax + coalesce(mu, 0) * (qx - ax) - 500, 2) + pow(ay + coalesce(mu, 0) * (qy - ay) - 300, 2)) as dist from m) select id, region, round(min(dist), 5) as distance from k group by all")
def snap_polyline(spark, d):
    s = G.snap(F.lit(500.0), F.lit(300.0), F.col("ring"))
    return _rings(spark, d).select("id", "region", F.round(s["distance"], 5).alias("distance"))


@q("line_position", f"with {_RING} select id, region, round(ax + 0.25 * (qx - ax), 5) as x, round(ay + 0.25 * (qy - ay), 5) as y from g where i = 2")
def line_position(spark, d):
    p = G.point_at(F.col("ring"), F.lit(1.25))
    return _rings(spark, d).select("id", "region", F.round(p["x"], 5).alias("x"), F.round(p["y"], 5).alias("y"))


@q("bbox_overlap", "select distinct video, frame_us, class_name, least(x1, x2) <= 900 and greatest(x1, x2) >= 500 and least(y1, y2) <= 600 and greatest(y1, y2) >= 300 as overlaps, least(x1, x2) >= 500 and greatest(x1, x2) <= 900 and least(y1, y2) >= 300 and greatest(y1, y2) <= 600 as inside, (x1 + x2) / 2 as cx from frame_label where x1 is not null and x2 is not null and y1 is not null and y2 is not null")
def bbox_overlap(spark, d):
    a, b = G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), G.box(F.lit(500), F.lit(300), F.lit(900), F.lit(600))
    rows = read(spark, d, "frame_label").where("x1 is not null and x2 is not null and y1 is not null and y2 is not null")
    return rows.select("video", "frame_us", "class_name", G.box_overlaps(a, b).alias("overlaps"), G.box_contains(b, a).alias("inside"), G.box_center(a)["x"].alias("cx")).distinct()


@q("bbox_clip", "select distinct video, frame_us, greatest(least(x1, x2), 500) as x1, greatest(least(y1, y2), 300) as y1, least(greatest(x1, x2), 900) as x2, least(greatest(y1, y2), 600) as y2 from frame_label where x1 is not null and x2 is not null and y1 is not null and y2 is not null and least(x1, x2) <= 900 and greatest(x1, x2) >= 500 and least(y1, y2) <= 600 and greatest(y1, y2) >= 300")
def bbox_clip(spark, d):
    a, b = G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), G.box(F.lit(500), F.lit(300), F.lit(900), F.lit(600))
    return read(spark, d, "frame_label").where("x1 is not null and x2 is not null and y1 is not null and y2 is not null").select("video", "frame_us", G.box_clip(a, b).alias("c")).where("c is not null").select("video", "frame_us", "c.*").distinct()




@q("morton", f"select l_orderkey, l_linenumber, {' + '.join(f'(((l_linenumber::bigint >> {i}) & 1) << {2 * i})' for i in range(8))} + {' + '.join(f'(((l_quantity::bigint >> {i}) & 1) << {2 * i + 1})' for i in range(8))} as z from lineitem")
def morton(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.morton(F.col("l_linenumber"), F.col("l_quantity").cast("bigint"), 8).alias("z"))


def _hilbert_sql(side: int) -> str:
    """The curves as a chain of steps, one a level: (h, x, y, d) and (s, u, v, e)."""
    out = [f"c0 as (select l_orderkey, l_linenumber, l_linenumber::bigint as x, {side - 1} - l_quantity::bigint as y, 0::bigint as d, case when l_linenumber > l_quantity then {side - 1} - l_linenumber else l_linenumber end::bigint as u, case when l_linenumber > l_quantity then {side - 1} - l_quantity else l_quantity end::bigint as v, (l_linenumber > l_quantity)::bigint as e from lineitem)"]
    level, n = side // 2, 0
    while level:
        rx, ry = f"(x & {level}) > 0", f"(y & {level}) > 0"
        flip = f"not ({ry}) and {rx}"
        fx, fy = f"(case when {flip} then {side - 1} - x else x end)", f"(case when {flip} then {side - 1} - y else y end)"
        far = f"u + v > {side - 1}"
        pu, pv = f"(case when {far} then {side - 1} - v else u end * 2)", f"(case when {far} then u else v end * 2)"
        high = f"{pv} > {side - 1}"
        out.append(
            f"c{n + 1} as (select l_orderkey, l_linenumber, case when {ry} then {fx} else {fy} end as x, case when {ry} then {fy} else {fx} end as y, d + {level * level} * (case when {rx} then 3 - ({ry})::bigint else ({ry})::bigint end) as d, "
            f"case when {high} then {pv} - {side - 1} else {pu} end as u, case when {high} then {side - 1} - {pu} else {pv} end as v, (e * 2 + ({far})::bigint) * 2 + ({high})::bigint as e from c{n})"
        )
        level, n = level // 2, n + 1
    return f"with {', '.join(out)} select l_orderkey, l_linenumber, d as h, e as s from c{n}"


@q("hilbert_sierpinski", _hilbert_sql(64))
def hilbert_sierpinski(spark, d):
    x, y = F.col("l_linenumber").cast("bigint"), F.col("l_quantity").cast("bigint")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.hilbert(x, y, 6).alias("h"), G.sierpinski(x, y, 63).alias("s"))


@q("mercator", "select distinct track_id, dt, lon, lat, round(radians(lon) * 6378137.0 + 20037508.342789244, 3) as x, round(20037508.342789244 - ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) as y from track_point where lon is not null and lat is not null")
def mercator(spark, d):
    m = G.map_position(F.col("lon"), F.col("lat"))
    return read(spark, d, "track_point").where("lon is not null and lat is not null").select("track_id", "dt", "lon", "lat", F.round(m["x"], 3).alias("x"), F.round(m["y"], 3).alias("y")).distinct()


@q("mercator_back", "select distinct track_id, dt, round(lon, 6) as lon, round(lat, 6) as lat from track_point where lon is not null and lat is not null")
def mercator_back(spark, d):
    m = G.mercator(F.col("lon"), F.col("lat"))
    b = G.from_mercator(m["x"], m["y"])
    return read(spark, d, "track_point").where("lon is not null and lat is not null").select("track_id", "dt", F.round(b["lon"], 6).alias("lon"), F.round(b["lat"], 6).alias("lat")).distinct()


@q("zoom_level", "select p_partkey, floor(log2(2 * pi() * 6378137.0 / 256 / (p_retailprice / 1000)))::int as zoom, floor(p_retailprice / 256)::bigint * 256 as low, ceil(p_retailprice / 256)::bigint * 256 as high from part")
def zoom_level(spark, d):
    p = F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", G.zoom_level(p / 1000).alias("zoom"), G.round_down(p, 256).alias("low"), G.round_up(p, 256).alias("high"))


@q("persp_flat", f"with {_E} select vec_id, round((x * 100) / (1.5 + 0.0005 * (x * 100) - 0.002 * (y * 100)) + 320, 4) as u, round((y * 100) / (1.5 + 0.0005 * (x * 100) - 0.002 * (y * 100)) + 240, 4) as v from e")
def persp_flat(spark, d):
    p = G.flat_to_camera(F.col("x") * 100, F.col("y") * 100, F.lit(1.5), F.lit(0.0005), F.lit(-0.002), 640, 480)
    return _e(spark, d).select("vec_id", F.round(p["x"], 4).alias("u"), F.round(p["y"], 4).alias("v"))


@q("persp_roundtrip", f"with {_E} select vec_id, round(x * 100, 4) as x, round(y * 100, 4) as y from e")
def persp_roundtrip(spark, d):
    args = (F.lit(1.5), F.lit(0.0005), F.lit(-0.002), 640, 480)
    p = G.flat_to_camera(F.col("x") * 100, F.col("y") * 100, *args)
    b = G.camera_to_flat(p["x"], p["y"], *args)
    return _e(spark, d).select("vec_id", F.round(b["x"], 4).alias("x"), F.round(b["y"], 4).alias("y"))


@q("persp_frustum")
def persp_frustum(spark, d):
    z = G.scale_at_bottom(1920, 1080, F.lit(0.0), F.col("zy"))
    return spark.range(1, 6).select((F.col("id") * -0.0001).alias("zy")).withColumn("z1", z).withColumn("f", G.frustum(1920, 1080, F.col("z1"), F.lit(0.0), F.col("zy"))).select("zy", "z1", "f.*")


# --- rasters ---------------------------------------------------------------------------------------------------------

_C = "c as (select l_suppkey % 7 as image, l_orderkey % 40 as x, l_linenumber as y, sum(l_quantity::bigint) % 256 as v from lineitem group by all)"


def _cells(spark, d, shift=0):
    x = read(spark, d, "lineitem")
    return x.groupBy((F.col("l_suppkey") % 7).alias("image"), (F.col("l_orderkey") % 40).alias("x"), F.col("l_linenumber").cast("bigint").alias("y")).agg(((F.sum(F.col("l_quantity").cast("bigint")) + shift) % 256).alias("v"))


@q("seg_histogram", "select l_suppkey % 7 as image, 'class ' || (l_linenumber % 5) as name, count(*) as n from lineitem where l_linenumber % 5 <> 4 group by all")
def seg_histogram(spark, d):
    names = spark.createDataFrame([(i, f"class {i}") for i in range(4)], "v int, name string")
    return R.histogram(read(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("image"), (F.col("l_linenumber") % 5).alias("v")), "image", names)


@q("raster_decode", "select ps as image, (i - 1) % 4 as x, ((i - 1) // 4)::int as y, ascii(substring(ps, i, 1)) as v from (select ps, unnest(range(1, len(ps) + 1))::int as i from (select distinct p_brand as ps from part))")
def raster_decode(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("image"), F.col("p_brand").cast("binary").alias("pixels")).distinct()
    return R.decode(p, "image", "pixels", 4)


@q("sad_rows", f"with {_C} select image, sum(abs(v - (v + 37) % 256))::bigint as sad, count(*) as n, sum(abs(v - (v + 37) % 256)) / count(*) > 4 as moving from c group by image")
def sad_rows(spark, d):
    a = _cells(spark, d)
    return R.absolute_difference(a, a.withColumn("v", (F.col("v") + 37) % 256), "image")


_NEAR = "n as (select a.image, a.x, a.y, a.v, b.v as w from c a join c b on a.image = b.image and abs(a.x - b.x) <= {r} and abs(a.y - b.y) <= {r})"


@q("blur_grid", f"with {_C}, {_NEAR.format(r=1)} select image, x, y, v::bigint as v, round(avg(w), 6) as filtered from n group by all")
def blur_grid(spark, d):
    return R.box_blur(_cells(spark, d), "image").select("image", "x", "y", "v", F.round("filtered", 6).alias("filtered"))


@q("median_grid", f"with {_C}, {_NEAR.format(r=2)} select image, x, y, v::bigint as v, list_sort(list(w))[count(w) // 2 + 1]::bigint as filtered from n group by all")
def median_grid(spark, d):
    return R.median_filter(_cells(spark, d), "image")


@q("outlier_grid", f"with {_C}, {_NEAR.format(r=2)}, m as (select image, x, y, v, list_sort(list(w))[count(w) // 2 + 1] as f from n group by all) select image, x, y, (case when abs(v - f) > 60 then f else v end)::bigint as v from m")
def outlier_grid(spark, d):
    return R.replace_outliers(_cells(spark, d), "image", 60)


@q("fill_grid", "with c as (select l_suppkey % 7 as image, l_orderkey % 40 as x, l_linenumber as y, nullif(sum(l_quantity::bigint) % 256, (sum(l_quantity::bigint) % 256) // 50 * 50) as v from lineitem group by all), n as (select a.image, a.x, a.y, a.v, b.v as w from c a join c b on a.image = b.image and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1) select image, x, y, round(coalesce(v, avg(w)), 6)::double as v from n group by image, x, y, v")
def fill_grid(spark, d):
    c = _cells(spark, d)
    return R.fill_invalid(c.withColumn("v", F.nullif(F.col("v"), (F.floor(F.col("v") / 50) * 50).cast("bigint"))), "image").select("image", "x", "y", F.round("v", 6).alias("v"))


@q("half_size", f"with {_C} select image, x // 2 as x, y // 2 as y, round(avg(v), 6) as v from c group by all")
def half_size(spark, d):
    return R.half_size(_cells(spark, d), "image").select("image", "x", "y", F.round("v", 6).alias("v"))


@q("local_contrast", f"with {_C}, {_NEAR.format(r=2)} select image, x, y, round(least(greatest((v - avg(w)) * 2 + 127.5, 0), 255), 5) as v from n group by image, x, y, n.v")
def local_contrast(spark, d):
    return R.local_contrast(_cells(spark, d), "image").select("image", "x", "y", F.round("v", 5).alias("v"))


@q("raster_threshold", f"with {_C} select image, x, y, case when v >= 128 then 255 else 0 end as v from c")
def raster_threshold(spark, d):
    return R.threshold(_cells(spark, d), 128)


@q("window_statistics", f"with {_C} select image, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as deviation from c where x >= 5 and x < 25 and y >= 2 and y < 6 group by image")
def window_statistics(spark, d):
    return R.window_statistics(_cells(spark, d), "image", 5, 2, 25, 6).select("image", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@q("mean_displacement", f"with {_E} select vec_id % 9 as image, round(avg(x) filter (where a > 0), 6) as dx, round(avg(y) filter (where a > 0), 6) as dy, count(*) filter (where a > 0) as n from e group by all")
def mean_displacement(spark, d):
    e = _e(spark, d).select((F.col("vec_id") % 9).alias("image"), F.col("x").alias("dx"), F.col("y").alias("dy"), (F.col("a") > 0).alias("valid"))
    return R.mean_displacement(e, "image").select("image", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), "n")


@q("replace_far", f"with {_E} select vec_id, case when sqrt(pow(x * 1000 - 10, 2) + pow(y * 1000 + 20, 2)) > 400 then 10.0 else x * 1000 end as dx, case when sqrt(pow(x * 1000 - 10, 2) + pow(y * 1000 + 20, 2)) > 400 then -20.0 else y * 1000 end as dy from e")
def replace_far(spark, d):
    return R.replace_far(_e(spark, d).select("vec_id", (F.col("x") * 1000).alias("dx"), (F.col("y") * 1000).alias("dy")), 10.0, -20.0)


@q("argmax_class", "select vec_id, list_position(embedding, list_max(embedding)) - 1 as class from embeddings")
def argmax_class(spark, d):
    return read(spark, d, "embeddings").select("vec_id", R.argmax_class(F.col("embedding")).alias("class"))


@q("tick_density", "select least(floor(o_orderkey * 200 / 1000000.0), 199)::int as slot, count(*) as n from orders group by all")
def tick_density(spark, d):
    return R.tick_density(read(spark, d, "orders"), "o_orderkey", 1000000, 200)


@q("best_cluster", f"with {_E}, p as (select vec_id % 5 as k, x, y from e), c as (select k, avg(x) as cx, avg(y) as cy, count(*) as n from p group by k) select p.k as cluster from p join c using (k) group by p.k, n having n >= 0.05 * (select count(*) from p) order by n / (avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) + 0.1) desc limit 1")
def best_cluster(spark, d):
    return R.best_cluster(_e(spark, d).select((F.col("vec_id") % 5).alias("cluster"), "x", "y"), "cluster").select("cluster")


@q("kmeans")
def kmeans(spark, d):
    return R.kmeans(_e(spark, d).select("vec_id", "x", "y")).select("vec_id", "cluster")


_TILES = "tile as (select 5 as z, l_partkey % 32 as x, l_suppkey % 32 as y, max(l_shipdate) as modified from lineitem group by all)"


def _tiles(spark, d):
    return read(spark, d, "lineitem").groupBy(F.lit(5).alias("z"), (F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y")).agg(F.max("l_shipdate").alias("modified"))


@q("tile_pyramid", f"with {_TILES}, up as (select z - u as z, x // power(2, u)::bigint as x, y // power(2, u)::bigint as y, modified from tile, range(0, 6) r(u)) select z::int as z, x, y, max(modified) as modified from up group by all")
def tile_pyramid(spark, d):
    return R.pyramid(_tiles(spark, d), 5)


@q("web_tiles", f"with {_TILES} select z, x * 4 + i as x, y * 4 + j as y, i::int as sx, j::int as sy, modified from tile, range(0, 4) a(i), range(0, 4) b(j)")
def web_tiles(spark, d):
    return R.web_tiles(_tiles(spark, d))


@q("stale_tiles", f"with {_TILES}, built as (select 5 as z, l_partkey % 32 as x, l_suppkey % 32 as y, max(l_shipdate) as b from lineitem where l_linenumber < 3 group by all) select z, x, y, modified from tile left join built using (z, x, y) where b is null or b < modified")
def stale_tiles(spark, d):
    built = read(spark, d, "lineitem").where("l_linenumber < 3").groupBy(F.lit(5).alias("z"), (F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y")).agg(F.max("l_shipdate").alias("modified"))
    return R.stale_tiles(_tiles(spark, d), built)
