"""Queries of file and database formats (what is written is read again), codecs, statements and schemas."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from wayledger.functions import codecs, projections, scalars, wkt
from wayledger.operators import labels as L
from wayledger.plans import expression as X
from wayledger.plans import schema
from wayledger.plans.dialects import connection
from wayledger.plans.registry import Catalog
from wayledger.plans.structure import _polygons
from wayledger.runtime import read, scratch
from wayledger.sources import dbf, flat, labelfiles, sqlite, tracks

CATALOG = Catalog()
q = CATALOG.query


def _text_files(lines, first: str, last: str | None, path: str) -> None:
    """Text files of the column ``line``, each with a first and a last line of its own."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = None
        for batch in batches:
            if batch.num_rows and shape is None:
                shape = batch.schema
                yield pa.RecordBatch.from_pydict({"line": [first]}, shape)
            yield batch
        if shape is not None and last is not None:
            yield pa.RecordBatch.from_pydict({"line": [last]}, shape)

    lines.select("line").mapInArrow(wrap, "line string").write.text(path)


@q("csv_roundtrip", "select id, coalesce(image_path, '') as image_path, region_id, coalesce(region, '') as region, coalesce(author, '') as author from sample")
def csv_roundtrip(spark, d):
    """Samples as delimited text and back: types found from all cells; null and '' are one in a text column."""
    path = scratch(spark, "csv")
    flat.write_csv(read(spark, d, "sample").select("id", "image_path", "region_id", "region", "author"), path, ";")
    return flat.read_csv(spark, path)


@q("csv_short_rows", "select p_partkey as id, p_name as name, case when p_size % 3 <> 0 then case when p_size % 3 = 1 then '' else p_brand end end as name_1, case when p_size % 3 <> 0 and p_size % 5 <> 0 then p_size::bigint end as size, case when p_size % 3 <> 0 then p_retailprice end as price from part")
def csv_short_rows(spark, d):
    """Parts between tabs, a header with a repeated name, some rows cut short, some cells empty."""
    p, size = read(spark, d, "part"), F.col("p_size")
    rest = [F.when(size % 3 == 1, "").otherwise(F.col("p_brand")), F.when(size % 5 == 0, "").otherwise(size.cast("string")), F.col("p_retailprice").cast("string")]
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.when(size % 3 != 0, F.concat_ws("\t", *rest)))
    path = scratch(spark, "short")
    _text_files(p.select(line.alias("line")), "id\tname\tname\tsize\tprice", None, path)
    return flat.read_csv(spark, path)


@q("csv_separators", "select * from (values (',', 1), (';', 2), (chr(9), 3)) t(separator, n)")
def csv_separators(spark, d):
    heads = ["a,b;x,c\n1,2,3\n4,5,6", "a;b;c\n1,5;2;3\n4;5,5;6", "a\tb\n1,5\t2\n"]
    return spark.createDataFrame([(flat.sniff_separator(h), i + 1) for i, h in enumerate(heads)], "separator string, n int")


@q("dbf_roundtrip", "select o_orderkey as orderkey, o_custkey as custkey, o_orderstatus as status, o_totalprice as total, o_orderdate as placed, o_orderpriority as priority from orders")
def dbf_roundtrip(spark, d):
    """Orders as dBase tables, one a partition, and back."""
    spark.dataSource.register(dbf.DbfSource)
    path = scratch(spark, "dbf")
    o = read(spark, d, "orders")
    named = o.select(*[F.col(f"o_{a}").alias(b) for a, b in (("orderkey", "orderkey"), ("custkey", "custkey"), ("orderstatus", "status"), ("totalprice", "total"), ("orderdate", "placed"), ("orderpriority", "priority"))])
    named.write.format("dbf").mode("append").save(path)
    return spark.read.format("dbf").load(path).withColumn("total", F.round("total", 2))


@q("sqlite_roundtrip", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def sqlite_roundtrip(spark, d):
    """The nations, a table of fixed size, in a SQLite file and back."""
    spark.dataSource.register(sqlite.SqliteSource)
    path = dbf.local_path(scratch(spark, "nation.db"))
    with sqlite3.connect(path) as c:
        c.execute("create table nation (n_nationkey integer, n_name text, n_regionkey integer)")
        c.executemany("insert into nation values (?, ?, ?)", [tuple(r) for r in read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    return spark.read.format("sqlite").option("path", path).option("dbtable", "nation").load()


@q("positions_json", "select dt, lon, lat, speed from track_point")
def positions_json(spark, d):
    """Track points as JSON arrays, one a file, and back."""
    path = scratch(spark, "positions")
    p = read(spark, d, "track_point").select(F.concat(F.lit(","), F.to_json(F.struct("dt", "lon", "lat", "speed"))).alias("line"))
    _text_files(p, "[{}", "]", path)
    return tracks.read_positions(spark, path).where("dt is not null or lon is not null or lat is not null or speed is not null").select("dt", "lon", "lat", "speed")


@q("speeds_roundtrip", "select dt as t, speed, 1700000000000 as time from track_point where dt is not null and speed is not null")
def speeds_roundtrip(spark, d):
    """Speeds as JSON objects {time, speeds}, one a file, and back."""
    path = scratch(spark, "speeds")
    p = read(spark, d, "track_point").where("dt is not null and speed is not null").select(F.concat(F.lit(",["), F.col("dt").cast("string"), F.lit(","), F.col("speed").cast("string"), F.lit("]")).alias("line"))
    _text_files(p, '{"time":1700000000000,"speeds":[[]', "]}", path)
    return tracks.read_speeds(spark, path).where("t is not null").select("t", "speed", "time")


@q(
    "frame_text",
    """with f as (select distinct video, frame_us, class_name, severity, labeler, edittime, x1, y1, x2, y2, poly from frame_label)
select video, frame_us, count(*) as n, sum(severity)::bigint as severity, max(edittime) as edited, count(*) filter (where x2 <> x1) as rects from f group by all""",
)
def frame_text(spark, d):
    """Label files of all frames, written and parsed."""
    shaped = lambda x: F.struct(F.array(F.struct(x["class_name"].alias("class"), x["severity"].alias("severity"))).alias("classes"), *[x[n].alias(n) for n in ("labeler", "edittime", "rect", "poly")])
    body = L.frames(read(spark, d, "frame_label")).select("video", "frame_us", labelfiles.frame_json(F.transform("labels", shaped)).alias("body"))
    labels = body.select("video", "frame_us", F.explode(labelfiles.parse_frame(F.col("body"))).alias("x"))
    return labels.groupBy("video", "frame_us").agg(F.count("*").alias("n"), F.sum(F.col("x.classes")[0]["severity"]).alias("severity"), F.max("x.edittime").alias("edited"), F.count("x.rect").alias("rects"))


@q("codecs", "select doc_id, true as zlib, true as lz4, true as zip, true as tile from documents where text is not null")
def codecs_(spark, d):
    t = read(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "utf-8").alias("b"))
    pairs = {"zlib": codecs.inflate(codecs.deflate(F.col("b"))), "lz4": codecs.unlz4(codecs.lz4(F.col("b"))), "zip": codecs.unzip_first(codecs.zip_one(F.col("b"), "text")), "tile": codecs.unpack_tile(codecs.pack_tile(F.col("b")))}
    return t.select("doc_id", *[(c == F.col("b")).alias(n) for n, c in pairs.items()])


_WKT_AREA = r"with p as (select distinct id, region, string_split(nullif(regexp_extract(region, '^\s*\[\s*\[\s*\[([-+0-9.eE,\s]*)\]\s*\]\s*\]\s*$', 1), ''), ',')::double[] as v from sample), e as (select id, region, v, unnest(range(1, len(v) // 2 + 1)) as i from p where len(v) >= 6 and len(v) % 2 = 0) select id, region, round(abs(sum(v[2*i-1] * v[(2*i+1-1) % len(v) + 2] - v[(2*i+1-1) % len(v) + 1] * v[2*i])) / 2, 4) as area from e group by all"


@q("polygon_lines", _WKT_AREA)
def polygon_lines(spark, d):
    """Polygons as lines and as polygons again have the area they had."""
    g = _polygons(spark, d).withColumn("g", wkt.geom_from_wkt("wkt"))
    return g.select("id", "region", F.round(wkt.geom_area(wkt.geom_to_polygon(wkt.geom_to_polyline("g"))), 4).alias("area"))


@q("ring_order", "select p_partkey, (p_size % 6 + 1)::int as rings, 2::int as exteriors, (p_size % 6)::int as deepest from part")
def ring_order(spark, d):
    """Squares in squares and one beside them: the level of each, and which are exterior."""

    @F.arrow_udf("struct<rings:int,exteriors:int,deepest:int>")
    def nested(sizes: pa.Array) -> pa.Array:
        out = []
        for n in sizes.to_pylist():
            box = lambda a, b, at=0: [[at + a, a], [at + b, a], [at + b, b], [at + a, b]]
            rings = [box(-k, k) for k in range(1, n % 6 + 2)] + [box(-1, 1, 100)]
            levels = wkt.ring_levels(rings)
            out.append({"rings": len(rings) - 1, "exteriors": sum(p["exterior"] for p in wkt.order_rings(rings)), "deepest": max(levels)})
        return pa.array(out, pa.struct([("rings", pa.int32()), ("exteriors", pa.int32()), ("deepest", pa.int32())]))

    return read(spark, d, "part").select("p_partkey", nested("p_size").alias("r")).select("p_partkey", "r.*")


#: Statements with the kind and the safety they must be found to have.
_STATEMENTS = [
    ("max(a) + 1", "expression", True), ("  SELECT a", "select", None), ("insert into t (a) values (1)", "insert", None), ("upper(a) || 'x' = $1", "expression", True),
    ("sleep(10)", "expression", False), ("case a when 1 then lower(b) else abs(c) end", "expression", True), ("cast(a as int)", "expression", False), ("st_area(g) > 2", "expression", True),
]


@q("statement_kinds", "select * from (values (0, 'expression', true), (1, 'select', null), (2, 'insert', null), (3, 'expression', true), (4, 'expression', false), (5, 'expression', true), (6, 'expression', false), (7, 'expression', true)) t(n, kind, safe)")
def statement_kinds(spark, d):
    kind = [X.statement_kind(text) for text, _, _ in _STATEMENTS]
    return spark.createDataFrame([(i, k, X.is_safe(X.parse(s[0])) if k == "expression" else None) for i, (k, s) in enumerate(zip(kind, _STATEMENTS))], "n int, kind string, safe boolean")


@q("insert_rows", "select r_regionkey, r_name from region union all select * from (values (7, 'it''s'), (8, null), (-9, 'x'))")
def insert_rows(spark, d):
    """The rows of an INSERT behind those of a table."""
    r = read(spark, d, "region").select("r_regionkey", "r_name")
    statement = X.parse_insert("INSERT INTO region (r_name, r_regionkey) VALUES ('it''s', 7), (null, 8), ('x', -9)")
    one = spark.range(1)
    for row in statement.rows:
        values = dict(zip(statement.fields, row))
        r = r.unionByName(one.select(*[F.expr(X.to_sql(values[f.name])).cast(f.dataType).alias(f.name) for f in r.schema]))
    return r


@q("expr_printed", "select l_orderkey, l_linenumber, l_quantity * 2 + l_tax > 50 and not (l_returnflag = 'R') as a, case when l_linenumber in (1, 2) then 'low' else l_returnflag || '-' || l_linestatus end as b, -l_quantity % 7 as c from lineitem")
def expr_printed(spark, d):
    """Expressions printed as SQL of the engine and read by it."""
    texts = {"a": "l_quantity * 2 + l_tax > 50 and not l_returnflag = 'R'", "b": "case when l_linenumber in (1, 2) then 'low' else l_returnflag || '-' || l_linestatus end", "c": "-l_quantity % 7"}
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(X.to_sql(X.parse(t))).alias(n) for n, t in texts.items()])


_SCHEMA = 'CREATE TABLE "road" road { required int64 rowid "Key" optional text(50) label "Label" optional pointzm(4326) place "Place" } PRIMARY KEY(rowid);'


@q("schema_fields", "select * from (values ('road', 'rowid', 'int64', true), ('road', 'label', 'text(50)', false), ('road', 'place', 'pointzm(4326)', false)) t(table_name, field, type, required)")
def schema_fields(spark, d):
    """Fields of a schema that was parsed, printed and parsed again."""
    s = schema.parse_schema(schema.print_schema(schema.parse_schema(_SCHEMA)))
    return spark.createDataFrame([(n, f.name, str(f.type), f.required) for n, t in s.tables.items() for f in t.fields], "table_name string, field string, type string, required boolean")


@q("table_fields", "select table_name, column_name as field, case data_type when 'BIGINT' then 'int64' when 'INTEGER' then 'int32' when 'VARCHAR' then 'text' when 'DOUBLE' then 'double' when 'BOOLEAN' then 'bool' else 'datetime' end as type from information_schema.columns where table_name in ('orders', 'part', 'sample', 'dimension_def', 'track_point', 'frame_label')")
def table_fields(spark, d):
    """The schema of existing tables."""
    rows = [(n, f.name, str(f.type)) for n in ("orders", "part", "sample", "dimension_def", "track_point", "frame_label") for f in schema.table_of(read(spark, d, n), n).fields]
    return spark.createDataFrame(rows, "table_name string, field string, type string")


@q("connections", "select * from (values ('postgres', 'db.example', 5432, 'roads', 'me')) t(driver, host, port, database, \"user\")")
def connections(spark, d):
    c = connection("postgres:db.example:5432:roads:me:secret")
    return spark.createDataFrame([tuple(c.get(k) for k in ("driver", "host", "port", "database", "user"))], "driver string, host string, port int, database string, user string")


def _utm_sql(srid: int, lon: str, lat: str) -> tuple[str, str, str]:
    """Columns of the steps, east and north of a zone, of degrees."""
    c, p = projections.crs_of(srid), projections
    steps = f"sinh(atanh(sin(radians({lat}))) - {p._E!r} * atanh({p._E!r} * sin(radians({lat})))) as t, radians({lon} - {c.meridian}) as d"
    xi, eta = "atan2(t, cos(d))", "atanh(sin(d) / sqrt(1 + t * t))"
    east = " + ".join([eta, *(f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(p._ALPHA, 1))])
    north = " + ".join([xi, *(f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(p._ALPHA, 1))])
    return steps, f"{c.scale * p._A!r} * ({east}) + {c.east}", f"{c.scale * p._A!r} * ({north}) + {c.north}"


_STEPS, _EAST, _NORTH = _utm_sql(32734, "lon", "lat")


@q("utm_positions", f"with p as (select distinct lon, lat from track_point where lon > 3 and lat is not null), s as (select *, {_STEPS} from p) select lon, lat, round({_EAST}, 3) as x, round({_NORTH}, 3) as y, round(lon, 7) as lon_back, round(lat, 7) as lat_back from s")
def utm_positions(spark, d):
    """Positions in a zone of Universal Transverse Mercator, and back from there. Those at lon 0 are beyond what the series is good for."""
    p = read(spark, d, "track_point").where("lon > 3 and lat is not null").select("lon", "lat").distinct()
    there = p.withColumn("p", projections.reproject(F.col("lon"), F.col("lat"), 4326, 32734))
    back = projections.reproject(F.col("p.x"), F.col("p.y"), 32734, 4326)
    return there.select("lon", "lat", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round(back["x"], 7).alias("lon_back"), F.round(back["y"], 7).alias("lat_back"))


@q("coordinate_systems", "select 32600 + z as srid, z * 6.0 - 183 as meridian from range(1, 61) t(z) union all select 32700 + z, z * 6.0 - 183 from range(1, 61) t(z) union all select 2046 + i, 15.0 + 2 * i from range(10) t(i)")
def coordinate_systems(spark, d):
    """Each known transverse system found again by its text."""
    known = [*range(32601, 32661), *range(32701, 32761), *range(2046, 2056)]
    rows = [(projections.srid_of_text(projections.crs_of(n).text()), projections.crs_of(n).meridian) for n in known]
    return spark.createDataFrame(rows, "srid long, meridian double")


@q("json_schema", "select event_id, coalesce((props->>'$.k')::int between 10 and 60, false) as ok from events")
def json_schema(spark, d):
    wanted = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}}
    return read(spark, d, "events").select("event_id", scalars.json_matches(F.col("props"), wanted).alias("ok"))
