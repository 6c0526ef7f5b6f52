"""Hashes, JSON Schema, projections, codecs and index statements on known values and hard inputs."""

import math
import os

import pytest
from pyspark.sql import functions as F

from wayledger.functions import codecs, projections, scalars
from wayledger.plans import schema


def test_known_hashes(spark):
    assert scalars.siphash24(bytes(range(15)), bytes(range(16))) == 0xA129CA6149BE45E5
    assert scalars.siphash24(b"", bytes(range(16))) == 0x726FDB47DD0E0E31
    df = spark.createDataFrame([("",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.xxh32("t")).collect()] == [0x02CC5D05, 0x32D153FF, None]
    assert [r[0] is None for r in df.select(scalars.siphash(F.col("t"))).collect()] == [False, False, True]


@pytest.mark.parametrize(
    "text, wanted, ok",
    [
        ('{"a": 1}', {"type": "object", "required": ["a"]}, True), ('{"a": 1}', {"required": ["b"]}, False), ("true", {"type": "integer"}, False), ("2.0", {"type": "integer"}, True),
        ("[1, 2]", {"type": "array", "items": {"type": "number", "maximum": 1}}, False), ('{"x": 1}', {"additionalProperties": False}, False), ('{"x": "y"}', {"additionalProperties": {"type": "string"}}, True),
        ('"abc"', {"pattern": "^a", "maxLength": 3}, True), ("null", {"type": ["null", "string"]}, True), ("3", {"enum": [1, 2]}, False), ("{", {}, False), (None, {}, None), ("[]", {"minItems": 1}, False),
    ],
)
def test_json_schema(spark, text, wanted, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(scalars.json_matches(F.col("t"), wanted)).first()[0] is ok


def test_projections(spark):
    df = spark.createDataFrame([(18.424055, -33.92487), (21.0, 0.0), (None, 1.0)], "lon double, lat double")
    p = df.select(projections.project(projections.crs_of(32734), F.col("lon"), F.col("lat")).alias("p")).collect()
    assert abs(p[0].p.x - 261878) < 1 and abs(p[0].p.y - 6243186) < 1
    assert abs(p[1].p.x - 500_000) < 1e-6 and abs(p[1].p.y - 10_000_000) < 1e-6 and p[2].p.x is None
    for srid in (4326, 3857, 32734, 2047, 32601):
        back = df.where("lon is not null").select("lon", "lat", projections.reproject(F.col("lon"), F.col("lat"), 4326, srid).alias("p"))
        back = back.select("lon", "lat", projections.reproject(F.col("p.x"), F.col("p.y"), srid, 4326).alias("b")).first()
        assert srid == 32601 or math.hypot(back.b.x - back.lon, back.b.y - back.lat) < 1e-9
    assert projections.srid_of_text("+proj=utm +zone=34 +south +datum=WGS84") == 32734
    text = 'PROJCS["x",GEOGCS["WGS 84"],PROJECTION["Transverse_Mercator"],PARAMETER["central_meridian",21],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",10000000]]'
    assert projections.srid_of_text(text) == 32734 and projections.srid_of_text('GEOGCS["WGS 84"]') == 4326
    own = projections.srid_of_text("+proj=tmerc +lon_0=20.5 +k=1 +x_0=0 +y_0=0")
    assert own < 0 and projections.srid_of_text(projections.crs_of(own).text()) == own
    with pytest.raises(ValueError):
        projections.crs_of(12345)
    with pytest.raises(ValueError):
        projections.parse_crs("+proj=robin")


def test_codecs(spark):
    values = [b"", b"a", b"abc" * 1000, os.urandom(5000), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, b binary").repartition(1)
    b = F.col("b")
    pairs = [codecs.inflate(codecs.deflate(b)), codecs.unlz4(codecs.lz4(b)), codecs.unzip_first(codecs.zip_one(b, "x")), codecs.unpack_tile(codecs.pack_tile(b))]
    for r in df.select("i", *[p.alias(f"p{k}") for k, p in enumerate(pairs)]).collect():
        assert all((None if x is None else bytes(x)) == values[r.i] for x in list(r)[1:])
    broken = df.where("i = 3").select(codecs.inflate(b), codecs.unlz4(b), codecs.unzip_first(b)).first()
    assert list(broken) == [None, None, None]


def test_index_statements():
    one = lambda tail: schema.parse_schema('CREATE TABLE "T" t { required int64 a "A" optional text b "B" }' + tail + ";")
    assert schema.index_ddl(schema.diff(one(""), one(" PRIMARY KEY(a) UNIQUE INDEX(a,b)"))) == ['ALTER TABLE "t" ADD CONSTRAINT "idx_t_a" PRIMARY KEY ("a")', 'CREATE UNIQUE INDEX "idx_t_a_b" ON "t" ("a", "b")']
    assert schema.index_ddl(schema.diff(one(" INDEX(b)"), one(""))) == ['DROP INDEX "idx_t_b"']
