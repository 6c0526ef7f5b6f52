"""Queries that leave no row out, whatever is hard to compare about it."""

from pyspark.sql import functions as F

from wayledger.plans.catalog import CATALOG
from wayledger.plans.tracks import _metric, _track
from wayledger.runtime import read


def test_heading_of_every_step(spark, data):
    steps = CATALOG.queries["heading_all"](spark, data)
    points = _metric(spark, data)
    assert steps.count() == points.count() - points.select("track_id").distinct().count()
    assert steps.where("angle is null and not stopped").isEmpty() and not steps.where("angle is null").isEmpty()


def test_url_codec_of_every_path(spark, data):
    coded = CATALOG.queries["url_codec_all"](spark, data)
    assert coded.count() == read(spark, data, "sample").select("image_path").distinct().count()
    assert not coded.where(F.col("image_path").contains("%")).isEmpty() and coded.where("not image_path <=> back").isEmpty()


def test_bounds_hold_every_point(spark, data):
    points = _track(spark, data).join(CATALOG.queries["track_bounds_all"](spark, data), "track_id", "left")
    assert points.where("x1 is null or lon < x1 - 1e-8 or lon > x2 + 1e-8 or lat < y1 - 1e-8 or lat > y2 + 1e-8").isEmpty()
