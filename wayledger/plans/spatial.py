"""Geometry functions for the expression language and for Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wayledger.functions import geometry, wkt
from wayledger.operators.raster import fill_polygons
from wayledger.plans.expression import register_function, to_column
from wayledger.plans.registry import Catalog
from wayledger.runtime import read

CATALOG = Catalog()

register_function("st_geomfromtext", wkt.geom_from_wkt)
register_function("st_geomfrom", wkt.geom_from_wkb)
register_function("st_astext", wkt.geom_to_wkt)
register_function("st_area", wkt.geom_area)
register_function("st_length", wkt.geom_length)
register_function("st_intersects", wkt.geom_intersects)
register_function("st_contains", wkt.geom_contains)
register_function("st_coarseintersect", wkt.geom_intersects_box)
register_function("as_guid", lambda c: F.upper(c))


def register(spark: SparkSession) -> None:
    """The functions that work on geometries, for ``spark.sql``."""
    for name, f in {"st_geomfromtext": wkt.geom_from_wkt, "st_geom_from_wkb": wkt.geom_from_wkb, "st_geom_to_text": wkt.geom_to_wkt, "st_geom_to_wkb": wkt.geom_to_wkb, "st_geom_intersects": wkt.geom_intersects, "st_geom_contains": wkt.geom_contains}.items():
        spark.udf.register(name, f)


_BOXES = "b as (select video, frame_us, class_name, least(x1, x2) as x1, least(y1, y2) as y1, greatest(x1, x2) as x2, greatest(y1, y2) as y2 from (select distinct * from frame_label) where x1 < x2 and y1 < y2)"


def _boxes(spark, d):
    rows = read(spark, d, "frame_label").distinct().where("x1 < x2 and y1 < y2")
    corner = lambda *c: F.concat_ws(" ", *[F.col(n).cast("string") for n in c])
    ring = F.concat_ws(", ", corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    return rows.withColumn("geom", wkt.geom_from_wkt(F.concat(F.lit("POLYGON(("), ring, F.lit("))")))).withColumn("other", wkt.geom_from_wkt(F.lit("POLYGON((500 300, 900 300, 900 600, 500 600, 500 300))")))


@CATALOG.query("spatial_predicates", f"with {_BOXES} select video, frame_us, class_name, ((x2 - x1) * (y2 - y1))::double as area, (2 * (x2 - x1) + 2 * (y2 - y1))::double as length, x1 <= 900 and x2 >= 500 and y1 <= 600 and y2 >= 300 as meets, x1 >= 500 and x2 <= 900 and y1 >= 300 and y2 <= 600 as inside from b")
def spatial_predicates(spark, d):
    b = _boxes(spark, d)
    e = {"area": "ST_Area(geom)", "length": "st_length(geom)", "meets": "st_intersects(geom, other)", "inside": "st_contains(other, geom)"}
    return b.select("video", "frame_us", "class_name", *[to_column(x, b).alias(n) for n, x in e.items()])


@CATALOG.query("polygon_masks", f"with {_BOXES} select class_name, count(*) as n from (select class_name, unnest(range(x1 // 50, 40)) as i, x1, y1, x2, y2 from b), range(0, 40) r(j) where i * 50 + 25 >= x1 and i * 50 + 25 < x2 and j * 50 + 25 >= y1 and j * 50 + 25 < y2 group by class_name")
def polygon_masks(spark, d):
    b = _boxes(spark, d)
    ring = F.transform(F.col("geom.parts")[0]["xy"], lambda v: geometry.point(v[0] / 50, v[1] / 50))
    return fill_polygons(b.select("class_name", ring.alias("ring")), "class_name", "ring", 40, 40).groupBy("class_name").agg(F.count("*").alias("n"))
