"""Reading and writing of position and speed tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_POINT = "dt double, lon double, lat double, time string, speed double"


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(file, dt, lon, lat, time, speed) of JSON files, each an array of points."""
    return spark.read.schema(_POINT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "*")


def positions_csv(points: DataFrame, x: str = "lon", y: str = "lat", t: str = "dt") -> DataFrame:
    """(line): 'lon,lat,time' with six, six and three decimals."""
    return points.select(F.format_string("%.6f,%.6f,%.3f", x, y, t).alias("line"))


def speeds_csv(points: DataFrame, t: str = "t", speed: str = "speed") -> DataFrame:
    return points.select(F.format_string("%.3f,%.1f", t, speed).alias("line"))


def speeds_json(points: DataFrame, track: str, start_ms: str, t: str = "t", speed: str = "speed") -> DataFrame:
    """One row a track: {"time": ms, "speeds": [[t, v], ...]}."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(t, speed))), lambda p: F.array(p[t], p[speed]))
    return points.groupBy(track).agg(F.to_json(F.struct(F.min(start_ms).alias("time"), pairs.alias("speeds"))).alias("body"))


def read_speeds(spark: SparkSession, path: str) -> DataFrame:
    """(file, time, t, speed) of JSON files {"time", "speeds": [[t, v], ...]}."""
    rows = spark.read.schema("time bigint, speeds array<array<double>>").option("multiLine", True).json(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), "time", F.explode("speeds").alias("p")).select("file", "time", F.get("p", F.lit(0)).alias("t"), F.get("p", F.lit(1)).alias("speed"))


def sections(points: DataFrame, size: int = 20, track: str = "track_id", t: str = "dt", shared: bool = True) -> DataFrame:
    """``points`` with ``section``: runs of ``size``; if ``shared``, a section ends with the first point of the next."""
    n = points.withColumn("_i", F.row_number().over(W.partitionBy(track).orderBy(t)) - 1)
    own = F.floor(F.col("_i") / size)
    both = F.when((F.col("_i") % size == 0) & (F.col("_i") > 0) & F.lit(shared), F.array(own - 1, own)).otherwise(F.array(own))
    return n.withColumn("section", F.explode(both)).drop("_i")


def sections_geojson(points: DataFrame, size: int = 20, track: str = "track_id", t: str = "dt") -> DataFrame:
    """(track, section, feature): a GeoJSON line of each section."""
    places = F.transform(F.array_sort(F.collect_list(F.struct(t, "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    line = F.struct(F.lit("Feature").alias("type"), F.struct().alias("properties"), F.struct(F.lit("LineString").alias("type"), places.alias("coordinates")).alias("geometry"))
    return sections(points, size, track, t).groupBy(track, "section").agg(F.to_json(line).alias("feature"))


def sections_wkt(points: DataFrame, size: int = 20, track: str = "track_id", t: str = "dt") -> DataFrame:
    """(track, section, first, wkt): sections that share no point, as lines of 'lon lat'."""
    places = F.transform(F.array_sort(F.collect_list(F.struct(t, "lon", "lat"))), lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    text = F.concat(F.lit("LINESTRING ("), F.array_join(places, ", "), F.lit(")"))
    return sections(points, size, track, t, shared=False).groupBy(track, "section").agg(F.min(t).alias("first"), text.alias("wkt"))
