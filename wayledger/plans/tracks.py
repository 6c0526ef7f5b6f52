"""Queries of tracks, series and statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayledger.functions import geometry as G
from wayledger.operators import series as S
from wayledger.operators.raster import cluster_statistics
from wayledger.plans.registry import Catalog
from wayledger.runtime import read
from wayledger.sources.tracks import sections

CATALOG = Catalog()
q = CATALOG.query

_T = "t as (select track_id, dt, avg(lon) as lon, avg(lat) as lat from track_point where dt is not null and track_id is not null and lon <> 0 group by all)"
_XY = _T + """, m as (select track_id, dt, radians(lon) * 6378137.0 as x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 as y from t)"""


def _track(spark, d):
    return S.clean_track(read(spark, d, "track_point").where("lon <> 0"))


def _metric(spark, d):
    m = G.mercator(F.col("lon"), F.col("lat"))
    return _track(spark, d).select("track_id", "dt", m["x"].alias("x"), m["y"].alias("y"))


def _r(*names, digits=4):
    return [F.round(n, digits).alias(n) for n in names]


@q("clean_track", f"with {_T} select track_id, dt, round(lon, 8) as lon, round(lat, 8) as lat from t")
def clean_track(spark, d):
    return _track(spark, d).select("track_id", "dt", *_r("lon", "lat", digits=8))


_ASOF = """
seg as (select track_id, dt as t1, lead(dt) over w as t2, lon as lon1, lead(lon) over w as lon2, lat as lat1, lead(lat) over w as lat2 from t window w as (partition by track_id order by dt)),
ends as (select track_id, min(dt) as a, max(dt) as b, arg_min(lon, dt) as lon_a, arg_max(lon, dt) as lon_b, arg_min(lat, dt) as lat_a, arg_max(lat, dt) as lat_b from t group by all),
found as (
  select q.track_id, q.qt, s.lon1 + (q.qt - t1) / (t2 - t1) * (lon2 - lon1) as lon, s.lat1 + (q.qt - t1) / (t2 - t1) * (lat2 - lat1) as lat, (lon2 - lon1) / (t2 - t1) as lon_rate, (lat2 - lat1) / (t2 - t1) as lat_rate
  from q join seg s on s.track_id = q.track_id and q.qt > t1 and q.qt < t2
  union all select q.track_id, q.qt, lon_a, lat_a, 0, 0 from q join ends using (track_id) where q.qt < a
  union all select q.track_id, q.qt, lon_b, lat_b, 0, 0 from q join ends using (track_id) where q.qt > b
  union all select q.track_id, q.qt, t.lon, t.lat, null, null from q join t on t.track_id = q.track_id and t.dt = q.qt)
"""


@q("asof_interpolate", f"with {_T}, q as (select distinct track_id, dt + 0.1375 as qt from track_point where dt is not null union select distinct track_id, dt - 1000 from track_point where dt is not null union select distinct track_id, dt from track_point where dt is not null), {_ASOF} select track_id, round(qt, 4) as qt, round(lon, 8) as lon, round(lat, 8) as lat from found")
def asof_interpolate(spark, d):
    p = read(spark, d, "track_point").where("dt is not null")
    times = p.select("track_id", F.explode(F.array(F.col("dt") + 0.1375, F.col("dt") - 1000, F.col("dt"))).alias("qt")).distinct()
    return S.interpolate(_track(spark, d), times).select("track_id", F.round("qt", 4).alias("qt"), *_r("lon", "lat", digits=8))


@q("asof_velocity", f"with {_T}, q as (select distinct track_id, dt + 0.1375 as qt from track_point where dt is not null), {_ASOF} select track_id, round(qt, 4) as qt, round(lon_rate * 1e5, 3) as lon_rate, round(lat_rate * 1e5, 3) as lat_rate from found")
def asof_velocity(spark, d):
    times = read(spark, d, "track_point").where("dt is not null").select("track_id", (F.col("dt") + 0.1375).alias("qt")).distinct()
    return S.interpolate(_track(spark, d), times).select("track_id", F.round("qt", 4).alias("qt"), *[F.round(F.col(n) * 1e5, 3).alias(n) for n in ("lon_rate", "lat_rate")])


@q("track_sample", f"with {_T}, q as (select track_id, a + i * 2.0 as qt from (select track_id, min(dt) as a, unnest(range(0, cast(floor((max(dt) - min(dt)) / 2.0 + 1e-9) as bigint) + 1)) as i from t group by track_id)), {_ASOF} select track_id, round(qt, 4) as qt, round(lon, 8) as lon, round(lat, 8) as lat from found")
def track_sample(spark, d):
    t = _track(spark, d)
    return S.interpolate(t, S.sample_times(t, 2.0)).select("track_id", F.round("qt", 4).alias("qt"), *_r("lon", "lat", digits=8))


_SPEED = "v as (select *, row_number() over w as n, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) / (dt - lag(dt) over w) as s from m window w as (partition by track_id order by dt)), sp as (select track_id, dt, case when n = 1 then lead(s) over (partition by track_id order by dt) else s end as speed from v)"


@q("track_velocity", f"with {_XY}, {_SPEED} select track_id, dt, round(speed, 3) as speed from sp")
def track_velocity(spark, d):
    return S.speeds(_metric(spark, d)).select("track_id", "dt", *_r("speed", digits=3))


@q("timeline_concat", f"with {_T}, e as (select track_id, max(dt) as e from t group by all), o as (select track_id, coalesce(sum(e) over (order by track_id rows between unbounded preceding and 1 preceding), 0) as o from e) select track_id, round(dt + o, 3) as dt from t join o using (track_id)")
def timeline_concat(spark, d):
    t = _track(spark, d)
    recordings = t.select("track_id").distinct().withColumn("position", F.col("track_id"))
    return S.concatenate(t, recordings).select("track_id", *_r("dt", digits=3))



@q("heading_all", f"with {_XY}, v as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from m window w as (partition by track_id order by dt)), z as (select *, abs(dx) + abs(dy) > 1e-3 as moves from v where dx is not null) select track_id, dt, case when moves then round(degrees(atan2(dy, dx)), 2) end as angle, sqrt(dx * dx + dy * dy) < 3 as stopped, case when moves then abs(degrees(atan2(0 * dx - 1 * dy, dx))) > 10 end as turned from z")
def heading_all(spark, d):
    """Every step; one under a millimetre has no direction, so its angle and turn are null."""
    v = S.steps(_metric(spark, d)).where("dx is not null")
    dx, dy = F.col("dx"), F.col("dy")
    moves = F.abs(dx) + F.abs(dy) > 1e-3
    return v.select("track_id", "dt", F.when(moves, F.round(S.heading(dx, dy), 2)).alias("angle"), S.is_stopped(dx, dy).alias("stopped"), F.when(moves, S.deviates(dx, dy, F.lit(1.0), F.lit(0.0))).alias("turned"))


@q("rolling_upper_median", "select event_id, list_sort(list(value) over w)[count(value) over w // 2 + 1] as m from events where value > 20 window w as (partition by user_id order by ts, event_id rows between 8 preceding and current row)")
def rolling_upper_median(spark, d):
    return S.rolling_upper_median(read(spark, d, "events").where("value > 20"), "user_id", ["ts", "event_id"], "value", 9, "m").select("event_id", "m")


@q("upper_median", "select event_type, list_sort(list(value))[count(value) // 2 + 1] as m from events group by event_type")
def upper_median(spark, d):
    return S.upper_median_by(read(spark, d, "events"), ["event_type"], "value").withColumnRenamed("median", "m")


@q("upper_median_whole", "select l_extendedprice as median from lineitem order by 1 limit 1 offset (select count(*) // 2 from lineitem)")
def upper_median_whole(spark, d):
    return S.upper_median_of(read(spark, d, "lineitem"), "l_extendedprice")


@q(
    "running_average",
    """with recursive e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select user_id, n, value as a from e where n = 1 union all select e.user_id, e.n, case when e.value < r.a * 2 then r.a + 0.05 * (e.value - r.a) else r.a end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, round(arg_max(a, n), 4) as average from r group by user_id""",
)
def running_average(spark, d):
    return S.running_average(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.05, 2.0).select("user_id", F.round("average", 4).alias("average"))


@q("scale_estimate", "with r as (select speed / ((3 + track_id % 5) * 30.0) as r from track_point where speed >= 5) select round((select r from r order by r limit 1 offset (select count(*) // 2 from r)), 8) as meters_per_pixel, (select count(*) from r) as n")
def scale_estimate(spark, d):
    p = read(spark, d, "track_point").withColumn("pixels", (3 + F.col("track_id") % 5).cast("double"))
    return S.scale_estimate(p, "speed", "pixels", 30.0).select(F.round("meters_per_pixel", 8).alias("meters_per_pixel"), "n")


@q(
    "quad_fit",
    """with p as (select l_returnflag, l_quantity / 10 as x, l_extendedprice / 1000 as y from lineitem),
s as (select l_returnflag, count(*)::double as n, sum(x) as x1, sum(x*x) as x2, sum(x*x*x) as x3, sum(x*x*x*x) as x4, sum(y) as y0, sum(x*y) as y1, sum(x*x*y) as y2 from p group by all),
d as (select *, x4*(x2*n-x1*x1) - x3*(x3*n-x1*x2) + x2*(x3*x1-x2*x2) as det from s),
f as (select l_returnflag, (y2*(x2*n-x1*x1) - x3*(y1*n-x1*y0) + x2*(y1*x1-x2*y0)) / det as a, (x4*(y1*n-x1*y0) - y2*(x3*n-x1*x2) + x2*(x3*y0-y1*x2)) / det as b, (x4*(x2*y0-y1*x1) - x3*(x3*y0-y1*x2) + y2*(x3*x1-x2*x2)) / det as c from d)
select l_returnflag, round(a, 4) as a, round(b, 3) as b, round(c, 3) as c from f""",
)
def quad_fit(spark, d):
    p = read(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return S.quadratic_fit(p, "x", "y", ["l_returnflag"]).select("l_returnflag", F.round("a", 4).alias("a"), F.round("b", 3).alias("b"), F.round("c", 3).alias("c"))


@q("mean_var", "select l_returnflag, round(avg(l_quantity), 6) as mean, round(var_samp(l_quantity), 4) as variance, min(l_quantity) as low, max(l_quantity) as high from lineitem group by all")
def mean_var(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.var_samp("l_quantity"), 4).alias("variance"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))



@q("track_bounds_all", f"with {_T} select track_id, round(min(lon), 8) as x1, round(min(lat), 8) as y1, round(max(lon), 8) as x2, round(max(lat), 8) as y2 from t group by all")
def track_bounds_all(spark, d):
    """Bounds over all points, also those averaged from a repeated time."""
    return _track(spark, d).groupBy("track_id").agg(*[F.round(f(n), 8).alias(a) for a, f, n in (("x1", F.min, "lon"), ("y1", F.min, "lat"), ("x2", F.max, "lon"), ("y2", F.max, "lat"))])


@q(
    "cluster_stats",
    """with p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y from embeddings), c as (select label, avg(x) as cx, avg(y) as cy, count(*) as n from p group by label),
s as (select p.label, any_value(n) as n, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) as tightness from p join c using (label) group by p.label)
select label, n, round(tightness, 4) as tightness, round(n / (tightness + 0.1), 3) as alpha from s""",
)
def cluster_stats(spark, d):
    p = read(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return cluster_statistics(p, "label").select("label", "n", F.round("tightness", 4).alias("tightness"), F.round("alpha", 3).alias("alpha"))


@q("track_sections", f"with {_T}, n as (select *, row_number() over (partition by track_id order by dt) - 1 as i from t), x as (select track_id, dt, i // 20 as section from n union all select track_id, dt, i // 20 - 1 from n where i % 20 = 0 and i > 0), y as (select track_id, section, count(*) as n_points, min(dt) as first, max(dt) as last from x group by all) select * from y where n_points > 1")
def track_sections(spark, d):
    return sections(_track(spark, d), 20, shared=True).groupBy("track_id", "section").agg(F.count("*").alias("n_points"), F.min("dt").alias("first"), F.max("dt").alias("last")).where("n_points > 1")


@q("track_simplify")
def track_simplify(spark, d):
    return S.simplify(_metric(spark, d), 2.0)


@q("track_smooth")
def track_smooth(spark, d):
    return S.smooth(_metric(spark, d), 0.3, 5.0)


@q(
    "emitted_frames",
    f"""with recursive {_XY}, {_SPEED}, p as (select m.track_id, m.dt, m.x, m.y, coalesce(sp.speed > 4, false) as fast, row_number() over (partition by m.track_id order by m.dt) as n from m join sp on sp.track_id = m.track_id and sp.dt = m.dt),
r as (select track_id, n, dt, x as ex, y as ey, true as emitted from p where n = 1
  union all select p.track_id, p.n, p.dt, case when p.fast or sqrt(pow(p.x - r.ex, 2) + pow(p.y - r.ey, 2)) > 1 then p.x else r.ex end, case when p.fast or sqrt(pow(p.x - r.ex, 2) + pow(p.y - r.ey, 2)) > 1 then p.y else r.ey end, p.fast or sqrt(pow(p.x - r.ex, 2) + pow(p.y - r.ey, 2)) > 1 from r join p on p.track_id = r.track_id and p.n = r.n + 1)
select track_id, dt from r where emitted""",
)
def emitted_frames(spark, d):
    m = _metric(spark, d)
    return S.emitted_frames(m.join(S.speeds(m), ["track_id", "dt"]))


@q("motion_state")
def motion_state(spark, d):
    m = S.steps(_metric(spark, d)).where("dx is not null")
    return S.motion_state(m.withColumn("diff", F.abs("dx") + F.abs("dy")))
