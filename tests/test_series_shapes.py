import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayledger.functions import geometry as G
from wayledger.functions import scalars
from wayledger.operators import labels as L
from wayledger.operators import raster as R
from wayledger.operators import series as S


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([(1, float(t), float(t * 10), 0.0) for t in (0, 1, 2, 4)], "track_id int, dt double, x double, y double")


def test_interpolation_cases(spark, line):
    times = spark.createDataFrame([(1, t) for t in (-5.0, 0.0, 0.5, 1.0, 3.0, 4.0, 9.0)] + [(2, 1.0)], "track_id int, qt double")
    got = {r.qt: (r.x, r.x_rate) for r in S.interpolate(line, times, values=("x", "y")).collect()}
    assert got == {-5.0: (0.0, 0.0), 0.0: (0.0, 0.0), 0.5: (5.0, 10.0), 1.0: (10.0, 10.0), 3.0: (30.0, 10.0), 4.0: (40.0, 10.0), 9.0: (40.0, 0.0)}


def test_speed_of_first_point(line):
    assert [r.speed for r in S.speeds(line).orderBy("dt").collect()] == [10.0] * 4


def test_upper_median_of_large_columns(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=30_001), np.repeat([1.0, 2.0, 5.0], 9000), rng.integers(0, 3, 25_000).astype(float), np.array([]), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        want = float(np.sort(values)[len(values) // 2]) if len(values) else None
        assert S.upper_median_of(df, "v").first().median == want


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=2, max_size=40), st.floats(0.1, 20))
def test_simplified_line_stays_close(points, tolerance):
    xy = np.array(points, float)
    keep = S._keep_simplified(xy, tolerance)
    assert keep[0] and keep[-1]
    at = np.flatnonzero(keep)
    for a, b in zip(at, at[1:]):
        along = xy[b] - xy[a]
        for p in xy[a + 1 : b]:
            mu = np.clip((p - xy[a]) @ along / max(along @ along, 1e-12), 0, 1)
            assert np.linalg.norm(p - xy[a] - mu * along) <= tolerance + 1e-9


def test_smoothing(spark):
    xy = [(0, 0), (10, 0), (20, 5), (20, 5.5), (30, 9)]
    df = spark.createDataFrame([(1, float(i), float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(2, 0.0, 1.0, 1.0)], "track_id int, dt double, x double, y double")
    out = S.smooth(df, 0.3, 2.0).toPandas().sort_values(["track_id", "dt"])
    one = out[out.track_id == 1]
    assert one.dt.iloc[0] == 0 and one.dt.iloc[-1] == 4 and (np.diff(one.dt) > 0).all() and len(out[out.track_id == 2]) == 1
    for a, b in xy:
        assert (np.abs(one.x - a) + np.abs(one.y - b)).min() < 1e-9
    assert S.smooth(df, 0.3, 100.0).count() == 6 and S.smooth(df.limit(0), 0.3, 2.0).count() == 0
    straight = S.smooth(df.where("dt < 2 and track_id = 1"), 0.0, 2.0).toPandas()
    assert np.abs(straight.y).max() < 1e-9


def test_simplify_is_the_same_in_pieces(spark):
    df = spark.createDataFrame([(1, float(i), float(i), 0.0) for i in range(100)], "track_id int, dt double, x double, y double")
    rng = np.random.default_rng(4)
    walk = rng.normal(size=(900, 2)).cumsum(axis=0)
    df = df.unionByName(spark.createDataFrame([(2, float(i), *map(float, p)) for i, p in enumerate(walk)] + [(3, 0.0, 1.0, 1.0)], df.schema))
    whole = sorted(map(tuple, S.simplify(df, 1.5).collect()))
    assert [r[1] for r in whole if r[0] == 1] == [0.0, 99.0] and 100 < len(whole) < 900
    assert sorted(map(tuple, S.simplify(df, 1.5, piece=300).collect())) == whole


def test_long_tracks_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(1, float(t), float(rng.normal()), float(rng.normal())) for t in rng.choice(5000, 1500, replace=False)] + [(2, float(t), 1.0 * t, 0.0) for t in range(40)]
    df = spark.createDataFrame(rows, "track_id int, dt double, x double, y double")
    times = df.select("track_id", (F.col("dt") + 0.5).alias("qt")).unionByName(spark.createDataFrame([(1, -5.0), (1, 1e6), (2, 7.0), (1, float(rows[3][1])), (5, 1.0)], "track_id int, qt double"))
    run = lambda: [sorted(map(str, f.collect())) for f in (S.interpolate(df, times, values=("x", "y")), S.segments(df, "track_id", "dt", ("x", "y")), S.speeds(df), S.steps(df), S.smooth(df, 0.3, 2.0))]
    whole = run()
    assert S.pieces(df, "track_id", "dt") is None
    monkeypatch.setattr(S, "SMALL_BYTES", 0)
    monkeypatch.setattr(S, "PIECE_ROWS", 100)
    cut = S.pieces(df, "track_id", "dt").collect()
    assert [r.track_id for r in cut] == [1] and len(cut[0]._bounds) == 15
    assert run() == whole and [len(x) for x in whole[:4]] == [1544, 1538, 1540, 1540]


def test_emitted_frames(spark):
    rows = [(1, float(i), x, 0.0, v) for i, (x, v) in enumerate([(0, 0), (0.5, 1), (0.9, 1), (1.2, 1), (1.3, 9), (1.4, 0)])]
    df = spark.createDataFrame([(a, b, float(c), d, float(e)) for a, b, c, d, e in rows], "track_id int, dt double, x double, y double, speed double")
    assert [r.dt for r in S.emitted_frames(df).orderBy("dt").collect()] == [0.0, 3.0, 4.0]


def test_motion_state(spark):
    rows = [(1, float(i), 0.5, 20.0, 10.0) for i in range(50)] + [(1, 50.0, 0.0, 20.0, 1000.0)]
    out = S.motion_state(spark.createDataFrame(rows, "track_id int, dt double, dx double, dy double, diff double")).orderBy("dt").collect()
    assert len(out) == 51 and math.isclose(out[-1].avg_diff, 10.0) and math.isclose(out[-1].bias_y, 20.0)


def test_quadratic_fit(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x * x - 8 * x + 3) for x in range(-5, 6)] + [(None, 1.0)], "x double, y double")
    r = S.quadratic_fit(df, "x", "y").first()
    assert [round(v, 6) for v in (r.a, r.b, r.c, r.vertex)] == [2, -8, 3, 2]
    assert S.quadratic_fit(df.where("x = 1"), "x", "y").first().a is None


def test_scale_needs_samples(spark):
    df = spark.createDataFrame([(10.0, 2.0)] * 199, "v double, p double")
    assert S.scale_estimate(df, "v", "p", 30.0).first().meters_per_pixel is None
    assert S.scale_estimate(df.unionByName(df), "v", "p", 30.0).first().meters_per_pixel == 10 / 60


def test_hilbert_walks_the_grid(spark):
    n = 8
    df = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    for curve, most in ((G.hilbert(F.col("x"), F.col("y"), 3), 1.0), (G.sierpinski(F.col("x"), F.col("y"), n - 1), 99)):
        rows = df.withColumn("d", curve).orderBy("d").collect()
        assert max(math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(rows, rows[1:])) <= most
    path = {r.d: (r.x, r.y) for r in df.withColumn("d", G.hilbert(F.col("x"), F.col("y"), 3)).collect()}
    assert len(path) == n * n and path[0] == (0, n - 1) and path[n * n - 1] == (n - 1, n - 1)
    one = {(r.x, r.y): r.d for r in df.where("x < 2 and y < 2").withColumn("d", G.hilbert(F.col("x"), F.col("y"), 1)).collect()}
    assert one == {(0, 0): 1, (1, 0): 2, (0, 1): 0, (1, 1): 3}


def test_perspective(spark):
    f = spark.range(1).select(G.scale_at_bottom(1920, 1080, F.lit(0.0), F.lit(-0.0003)).alias("z")).withColumn("f", G.frustum(1920, 1080, F.col("z"), F.lit(0.0), F.lit(-0.0003))).first()
    assert abs((f.f.x2 - f.f.x1) / 1920 - 1) < 1e-5


def test_regions(spark):
    texts = ["[[[0,0,4,0,4,3,0,3]]]", "[[[0,0,4,0,4,3]]]", "[[[0,0,4,0]]]", "[[]]", "", None, "[[[0,0,4,0,4]]]", "[[[0,x,4,0,4,3]]]", "[[[5.5,6,7"]
    rows = spark.createDataFrame([(t,) for t in texts], "region string").withColumn("p", L.region_points("region")).select(F.size("p").alias("n"), L.is_rectangle(F.col("p")).alias("r")).collect()
    assert [(r.n if r.n and r.n > 0 else None, r.r) for r in rows] == [(4, True), (3, False)] + [(None, False)] * 7


def test_command_errors(spark):
    c = spark.createDataFrame([("i", 0, "", "d", "a"), ("", 0, "", "d", "a"), ("i", 0, "", "", "a"), ("i", 0, "", "d", None), ("i", 0, "[[]]", "d", "a"), ("i", 0, "[[[0,0,9,0,9,3,0,3]]]", "d", "a"), ("i", 0, "[[[0,0,8,0,8,3,0,3]]]", "d", "a")], "image string, region_id long, region string, dimension string, author string")
    images = spark.createDataFrame([("i", 8, 8)], "image_path string, width int, height int")
    assert sorted(r.error or "" for r in L.check_commands(c, images).collect()) == ["", "", "author may not be empty", "dimension may not be empty", "image may not be empty", "region extends beyond the image", "region is broken"]


def test_kmeans_and_best(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal((0, 0), 0.1, (60, 2)), rng.normal((9, 9), 2.0, (60, 2)), [[50, 50]]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    best = R.best_cluster(R.kmeans(df, 3), "cluster").first()
    assert math.hypot(best.cx, best.cy) < 0.5


@given(st.text("abcx", max_size=30), st.text("abcx", max_size=30))
def test_diff_leads_there(a, b):
    assert scalars.apply_ops(a, scalars.diff_ops(a, b)) == b


def test_shortcut_keys():
    assert scalars.shortcut_keys(["Asphalt", "All", "a", "map crack", "mill cut"]) == ["A", "L", "B", "M", "C"]


def test_scalar_edges(spark):
    df = spark.createDataFrame([("a+b c",), ("%zz",), ("",), (None,)], "t string")
    rows = df.select(scalars.url_decode(F.col("t")).alias("d"), scalars.split_text(F.col("t"), "+").alias("s"), scalars.unhex(F.lit("abc")).alias("h"), scalars.fnv1a("t").alias("f")).collect()
    assert [r.d for r in rows] == ["a+b c", None, "", None] and [r.s for r in rows] == [["a", "b c"], ["%zz"], [], None]
    assert rows[0].h is None and rows[2].f == 2166136261 and rows[3].f is None
    q = spark.createDataFrame([("a=1&b=&a=2&&c",)], "q string").select(scalars.query_string(F.col("q")).alias("m")).first().m
    assert q == {"a": "1", "b": "", "c": ""}


def test_circles(spark):
    from wayledger.functions.circles import solve_circle, solve_circles

    rng = np.random.default_rng(2)
    th = (np.arange(4) + rng.uniform(-0.01, 0.01, 4)) * np.pi / 2
    clicked = np.column_stack([10 * np.cos(th) - 300, 10 * np.sin(th) - 200])
    out = solve_circle(clicked)
    assert len(out) == 15 and np.abs(np.linalg.norm(out - [-300, -200], axis=1) - 10).max() < 0.5
    h = np.array([[2.0, 0.1, 5], [0.2, 1.5, -3], [0.1, 0.3, 1]])  # a tilted view
    view = lambda a: (lambda p: p[:, :2] / p[:, 2:])(np.column_stack([np.cos(a), np.sin(a), np.ones(len(a))]) @ h.T)
    got = solve_circle(view(np.arange(8) * np.pi / 4))
    assert np.abs(got - view(np.arange(15) * 2 * np.pi / 15)).max() < 1e-3
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(clicked)] + [(2, 0, 1.0, 1.0), (2, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "circle_id int, n int, x double, y double")
    assert {r.circle_id: r["count"] for r in solve_circles(df).groupBy("circle_id").count().collect()} == {1: 15, 2: 1}
    with pytest.raises(ValueError):
        solve_circle(clicked[:2])


def test_motion_stream_agrees_with_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, float(t), float(rng.normal(0, 9)), float(20 + rng.normal(0, 9)), float(rng.uniform(5, 40))) for t in range(120) for k in (1, 2)]
    schema = "track_id int, dt double, dx double, dy double, diff double"
    for i in range(3):
        spark.createDataFrame(rows[i * 80 : i * 80 + 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(0.05)
    from wayledger.streaming.jobs import motion_stream

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = motion_stream(stream, "track_id", "dt", "dx", "dy", "diff").writeStream.format("memory").queryName("motion").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = S.motion_state(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.table("motion").collect())) == sorted(map(tuple, want.collect()))


def test_xml(spark):
    df = spark.createDataFrame([('<row id="3"><name>x</name></row>',)], "t string")
    x = df.select(scalars.xml_parse(F.col("t"), "_id int, name string").alias("x"))
    assert tuple(x.first().x) == (3, "x")
    assert "<name>x</name>" in x.select(scalars.xml_text(F.col("x")).alias("t")).first().t


def test_medians_of_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 30_001), (None, 4000), ("b", 1), ("c", 2)) for v in rng.normal(size=n)] + [("t", 1.0)] * 50 + [("t", 2.0)] * 50 + [("n", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: sorted(v for k, v in rows if k == g and v is not None and v == v) for g in ("a", None, "b", "c", "t")}
    for accuracy in (10_000, 20):
        assert {r.g: r.median for r in S.upper_median_by(df, ["g"], "v", accuracy).collect()} == {g: v[len(v) // 2] for g, v in want.items()}


def test_every_byte_is_decoded(spark):
    df = spark.createDataFrame([(1, bytes(range(256))), (2, b""), (3, None)], "image int, pixels binary")
    got = sorted((r.y * 16 + r.x, r.v) for r in R.decode(df, "image", "pixels", 16).collect())
    assert got == [(i, i) for i in range(256)]
