import datetime
import json
import sqlite3
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayledger.functions import wkt
from wayledger.sources import dbf, flat, labelfiles, shapefile, sqlite, tracks


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id;v;name;id;g\r\n1;1.5;"x;""y""";7;POINT(1 2)\r\n2;;;8;\r\n3;2e3\r\n')
    df = flat.read_flat(spark, path)
    assert [(f.name, f.dataType.simpleString()[:6]) for f in df.schema] == [("id", "bigint"), ("v", "double"), ("name", "string"), ("id_1", "bigint"), ("g", "struct")]
    rows = [(r.id, r.v, r.name, r.id_1, r.g and r.g.kind) for r in df.collect()]
    assert rows == [(1, 1.5, 'x;"y"', 7, "point"), (2, None, "", 8, None), (3, 2000.0, None, None, None)]


def test_csv_pieces(spark, tmp_path):
    assert [flat.sniff_separator(t) for t in ("a,b\n1,2\n", "a\tb\tc\n1\t2\t3\n", "a,b;c\n1;2\n", "single\n")] == [",", "\t", ";", ","]
    assert flat.unique_headers(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]
    assert [flat.type_of_mask(m) for m in (0, 1, 2, 3, 65, 4, 20, 5)] == ["string", "bigint", "double", "double", "string", "point", "geometry", "string"]
    flat.write_csv(spark.createDataFrame([("a,b", 'q"q'), ("c\nd", "")], "x string, y string").coalesce(1), str(tmp_path / "out"))
    back = flat.read_csv(spark, str(tmp_path / "out"), ",")
    assert sorted((r.x, r.y) for r in back.collect()) == [("a,b", 'q"q'), ("c\nd", "")]
    with pytest.raises(ValueError):
        flat.read_flat(spark, "x.pdf")


def test_dbf(spark, tmp_path):
    spark.dataSource.register(dbf.DbfSource)
    day = datetime.datetime(2024, 2, 29, 12, 30)
    df = spark.createDataFrame([(1, 10**12, 1.25, "é", True, day.date(), day), (None,) * 7], "a int, b bigint, c double, d string, e boolean, f date, g timestamp_ntz")
    df.coalesce(1).write.format("dbf").mode("append").save(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*.dbf")
    back = flat.read_flat(spark, str(file))
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    raw = bytearray(file.read_bytes())
    header = dbf.read_header(str(file))
    raw[header.start] = ord("*")  # erased
    file.write_bytes(raw)
    assert flat.read_flat(spark, str(file)).count() == 1


def make_shapes(path, shapes, kind):
    body, index, at = b"", b"", 50
    for i, s in enumerate(shapes, 1):
        body += struct.pack(">ii", i, len(s) // 2) + s
        index += struct.pack(">ii", at, len(s) // 2)
        at += 4 + len(s) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n) + struct.pack("<ii", 1000, kind) + bytes(64)
    path.with_suffix(".shp").write_bytes(head(50 + len(body) // 2) + body)
    path.with_suffix(".shx").write_bytes(head(50 + len(index) // 2) + index)


def test_shapefile(spark, tmp_path):
    ring = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    points = b"".join(struct.pack("<dd", *p) for p in ring + hole)
    polygon = struct.pack("<i4d", 5, 0, 0, 4, 4) + struct.pack("<iiii", 2, 10, 0, 5) + points
    make_shapes(tmp_path / "p.x", [polygon, struct.pack("<i", 0)], 5)
    write(tmp_path / "p.prj", 'GEOGCS["GCS_WGS_1984"]')
    df = spark.createDataFrame([(1,), (2,)], "n int")
    dbf.write_dbf(str(tmp_path / "p.dbf"), df.schema, iter(df.collect()))
    back = flat.read_flat(spark, str(tmp_path / "p.shp")).withColumn("area", wkt.geom_area(F.col("geometry")))
    first, second = back.orderBy("n").collect()
    assert (first.geometry.kind, first.geometry.srid, first.area, [p.exterior for p in first.geometry.parts]) == ("polygon", 4326, 15.0, [True, False])
    assert second.geometry is None and back.columns[0] == "geometry"
    (tmp_path / "p.shx").unlink()
    assert flat.read_flat(spark, str(tmp_path / "p.shp")).count() == 2


@pytest.mark.parametrize("code, dims", [(1, "xy"), (11, "xyzm"), (21, "xym")])
def test_shape_points(code, dims):
    numbers = [1.0, 2.0, 3.0, 4.0][: len(dims)]
    g = shapefile.shape(struct.pack("<i", code) + struct.pack(f"<{len(numbers)}d", *numbers))
    assert (g["dims"], g["parts"][0]["xy"]) == (dims, [numbers])


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("create table t (id integer primary key, name text not null, v real, odd integer)")
        c.executemany("insert into t values (?, ?, ?, ?)", [(i * 3, f"n{i}", i / 2, "x" if i == 5 else i) for i in range(1, 21)])
        c.execute("create unique index u on t (name)")
        c.execute("create table empty (a text)")
    spark.dataSource.register(sqlite.SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("dbtable", "t").load()
    assert df.schema.simpleString() == "struct<id:bigint,name:string,v:double,odd:bigint>"
    assert df.count() == 20 and df.where("odd is null").count() == 1 and df.rdd.getNumPartitions() == 4
    assert spark.read.format("sqlite").option("path", path).option("dbtable", "empty").load().count() == 0
    assert sqlite.database_schema(path)["t"]["indexes"] == [{"name": "u", "unique": True, "fields": ["name"]}]


@pytest.mark.parametrize(
    "sql, fields",
    [
        ("CREATE TABLE t (a INTEGER PRIMARY KEY, b VARCHAR(20) NOT NULL)", [("a", "INTEGER"), ("b", "VARCHAR(20)")]),
        ('create table if not exists "my t" ("a b" int, c, PRIMARY KEY("a b", c))', [("a b", "int"), ("c", "")]),
        ("CREATE TABLE [x] ([d] NUMERIC(10, 2) DEFAULT (1+1))", [("d", "NUMERIC(10, 2)")]),
    ],
)
def test_create_table(sql, fields):
    assert sqlite.parse_create_table(sql)[1] == fields


def test_frames(spark, tmp_path):
    old = {"edittime": 77, "labels": [{"classes": [["crack", "3"], ["patch"]], "labeler": "x", "rect": {"x1": 1, "y1": 2, "x2": 5, "y2": 6}}, {"classes": [["hole"]], "poly": [0, 0, 4, 0, 4, 4], "edittime": 99}]}
    write(tmp_path / "2000.json", json.dumps(old))
    write(tmp_path / "1000.json", json.dumps({"labels": []}))
    write(tmp_path / "notes.txt", "no frame")
    frames = labelfiles.read_frames(spark, str(tmp_path))
    first, second = frames.collect()
    assert (first.time, second.time) == (1000, 2000)
    a, b = second.labels
    assert (a.edittime, b.edittime, a.classes[0].severity, a.classes[1].severity, a.rect.x2, b.poly) == (77, 99, 3, None, 5, [0, 0, 4, 0, 4, 4])
    labelfiles.write_frames(frames, str(tmp_path / "copy"))
    assert labelfiles.read_frames(spark, str(tmp_path / "copy")).collect() == [first, second]


def test_dimension_files():
    rows = labelfiles.read_dimensions(json.dumps({"a": {"explain": "e", "type": "polygon", "values": {"x": {"title": "X", "hasIntensity": True}}}, "b": {"values": [1, 2.0, "z"]}, "old": ["p", 3]}))
    assert [(r["dimension"], r["type"], r["label"], r["title"], r["has_intensity"]) for r in rows] == [("a", "polygon", "x", "X", True), ("b", "whole", "1", "1", False), ("b", "whole", "2", "2", False), ("b", "whole", "z", "z", False), ("old", "whole", "p", "p", False), ("old", "whole", "3", "3", False)]
    assert labelfiles.sign_values(["r1_stop.png", "w2.svg"]) == {"r1": "r1_stop.png", "w2": "w2.svg"}
    with pytest.raises(ValueError):
        labelfiles.sign_values(["r1_a.png", "r1.png"])


def test_pictures(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 400) + bytes(10)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PNG").write_bytes(png)
    (tmp_path / "y.jpg").write_bytes(jpeg)
    (tmp_path / "z.txt").write_bytes(b"")
    assert [r.path.rsplit("/", 1)[1] for r in labelfiles.list_files(spark, str(tmp_path)).collect()] == ["x.PNG", "y.jpg"]
    assert [labelfiles.picture_size(x) for x in (png, jpeg, b"", jpeg[:12])] == [(640, 480), (400, 300), None, None]
    df = spark.createDataFrame([(png,), (None,)], "c binary").select(labelfiles.picture_size_column("c").alias("s"))
    assert [r.s and tuple(r.s) for r in df.collect()] == [(640, 480), None]


def test_upload_batches(spark):
    rows = spark.createDataFrame([(f"u{i}", "m", "v1", {"crack": i}) for i in range(10)], "url string, model string, version string, counts map<string,int>")
    batches = labelfiles.upload_batches(rows).orderBy("batch").collect()
    assert [len(json.loads(b.body)["Photos"]) for b in batches] == [8, 2]


def test_tracks(spark, tmp_path):
    write(tmp_path / "t.json", json.dumps([{"dt": 0.5, "lon": 1.0, "lat": 2.0}, {"dt": 1.5, "lon": 1.5, "lat": 2.5, "speed": 3}]))
    points = tracks.read_positions(spark, str(tmp_path / "t.json"))
    assert [r.line for r in tracks.positions_csv(points).orderBy("line").collect()] == ["1.000000,2.000000,0.500", "1.500000,2.500000,1.500"]
    speeds = spark.createDataFrame([(1, 5000, 0.5, 2.0), (1, 5000, 0.25, 1.0)], "track_id int, start bigint, t double, speed double")
    body = tracks.speeds_json(speeds, "track_id", "start").first().body
    assert json.loads(body) == {"time": 5000, "speeds": [[0.25, 1.0], [0.5, 2.0]]}
    write(tmp_path / "s.json", body)
    assert tracks.read_speeds(spark, str(tmp_path / "s.json")).count() == 2
    line = spark.createDataFrame([(1, float(i), float(i), 0.0) for i in range(41)], "track_id int, dt double, lon double, lat double")
    features = [json.loads(r.feature) for r in tracks.sections_geojson(line).orderBy("section").collect()]
    assert [len(f["geometry"]["coordinates"]) for f in features] == [21, 21, 1]
    assert [r.wkt.count(",") for r in tracks.sections_wkt(line).orderBy("section").collect()] == [19, 19, 0]


# --- geometry formats -----------------------------------------------------------------------------------------

SQUARE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"


@pytest.mark.parametrize(
    "text",
    ["POINT(1 2)", "POINT Z(1 2 3)", "POINT ZM(1 2 3 4.5)", "MULTIPOINT((1 2), (3 4))", "LINESTRING(0 0, 1 1.5)", "LINESTRING M(0 0 7, 1 1 8)", "MULTILINESTRING((0 0, 1 1), (2 2, 3 3))", SQUARE, "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "POINT EMPTY"],
)
def test_wkt_and_wkb(text):
    g = wkt.parse_wkt(text)
    assert wkt.write_wkt(g) == text
    assert wkt.parse_wkb(wkt.write_wkb(g)) == g or text == "POINT EMPTY"
    if text != "POINT EMPTY":
        assert wkt.parse_json(wkt.write_json(g)) == g


def test_wkt_spellings():
    assert wkt.parse_wkt(" srid=4326; Point z ( 1e2 -.5 3. ) ") == wkt.geometry("point", [{"closed": False, "exterior": False, "xy": [[100.0, -0.5, 3.0]]}], 4326, "xyz")
    assert wkt.write_wkb(wkt.parse_wkt("SRID=4326;POINT(1 2)"))[:9] == b"\x01\x01\x00\x00\x20\xe6\x10\x00\x00"
    assert wkt.parse_wkb(b"\x00" + struct.pack(">Idd", 1, 1, 2))["parts"][0]["xy"] == [[1.0, 2.0]]
    assert wkt.parse_wkb(b"\x01" + struct.pack("<Iddd", 1001, 1, 2, 3))["dims"] == "xyz"
    for bad in ("", "POINT(1)", "POINT(1 2", "CIRCLE(1 2)", "POLYGON((0 0, x 1))", "LINESTRING(1 2 3)"):
        with pytest.raises(wkt.GeometryError):
            wkt.parse_wkt(bad)
    for bad in (b"", b"\x01\x02", b"\x01" + struct.pack("<I", 99), b"\x01" + struct.pack("<II", 2, 2**31)):
        with pytest.raises(wkt.GeometryError):
            wkt.parse_wkb(bad)


def test_rings():
    box = lambda a, b: [[a, a], [b, a], [b, b], [a, b]]
    rings = [box(2, 3), box(0, 10), box(1, 5), box(6, 7), box(20, 21)]
    assert wkt.ring_parents(rings) == [2, -1, 1, 1, -1]
    assert wkt.ring_levels(rings) == [2, 0, 1, 1, 0]
    parts = wkt.order_rings(rings)
    assert [(p["exterior"], wkt.signed_area(p["xy"]) > 0) for p in parts] == [(True, True), (False, False), (False, False), (False, False), (True, True)]
    assert wkt.ring_parents([box(0, 1), box(0, 1)]) in ([-1, 0], [1, -1])
    line = wkt.to_polyline(wkt.parse_wkt(SQUARE))
    assert wkt.write_wkt(wkt.to_polygon(line)) == SQUARE
    assert wkt.with_dims(wkt.parse_wkt("POINT ZM(1 2 3 4)"), "xym")["parts"][0]["xy"] == [[1.0, 2.0, 4.0]]


@settings(max_examples=60)
@given(st.lists(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=2, max_size=6), min_size=1, max_size=4))
def test_lines_survive(lines):
    g = wkt.geometry("polyline", [{"closed": False, "exterior": False, "xy": [list(p) for p in line]} for line in lines])
    assert wkt.parse_wkb(wkt.write_wkb(g)) == g
    assert wkt.parse_wkt(wkt.write_wkt(g)) == g


def test_geometry_columns(spark):
    df = spark.createDataFrame([(SQUARE,), ("nonsense",), (None,)], "t string").withColumn("g", wkt.geom_from_wkt("t"))
    rows = df.select(wkt.geom_area(F.col("g")).alias("a"), wkt.geom_contains_point(F.col("g"), F.lit(3.0), F.lit(3.0)).alias("i"), wkt.geom_contains_point(F.col("g"), F.lit(1.5), F.lit(1.5)).alias("h"), wkt.geom_intersects_box(F.col("g"), 4, 4, 9, 9).alias("b")).collect()
    assert tuple(rows[0]) == (15.0, True, False, True)
    assert rows[1].i is None and rows[2].i is None


@pytest.mark.parametrize(
    "a, b, meets, covers",
    [
        ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POINT(4 2)", True, True),
        ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "LINESTRING(-1 2, 5 2)", True, False),
        (SQUARE, "POINT(1.5 1.5)", False, False),
        (SQUARE, "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", True, False),
        ("POLYGON((0 0, 9 0, 9 9, 5 9, 5 3, 4 3, 4 9, 0 9, 0 0))", "LINESTRING(1 8, 8 8)", True, False),
        ("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0))", "POLYGON((1 1, 2 1, 2 2, 1 1))", True, True),
        ("POLYGON((1 1, 2 1, 2 2, 1 1))", "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0))", True, False),
        ("LINESTRING(0 0, 2 2)", "LINESTRING(0 2, 2 0)", True, False),
        ("LINESTRING(0 0, 2 2)", "LINESTRING(3 3, 4 4)", False, False),
        ("MULTIPOINT((1 1), (2 2))", "POINT(2 2)", True, True),
    ],
)
def test_predicates(a, b, meets, covers):
    x, y = wkt.parse_wkt(a), wkt.parse_wkt(b)
    assert (wkt.intersects(x, y), wkt.intersects(y, x), wkt.covers(x, y)) == (meets, meets, covers)
