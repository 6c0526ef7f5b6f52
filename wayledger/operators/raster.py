"""Rasters as tables of (image, x, y, v), their statistics and neighbourhood filters, and the tile pyramid.

A neighbourhood is reached by sending each cell to its neighbours (explode) and aggregating there: one
shuffle by block, with a margin as wide as the filter, no self join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions.geometry import box_of, inside
from wayledger.operators.series import upper_median


def decode(rasters: DataFrame, image: str, pixels: str, width: int) -> DataFrame:
    """(image, x, y, v) of rasters with one byte per cell."""
    letters = F.slice(F.split(F.decode(pixels, "ISO-8859-1"), ""), F.lit(1), F.length(pixels))  # a letter a byte
    codes = F.transform(letters, lambda c, i: F.struct((i % width).alias("x"), F.floor(i / width).cast("int").alias("y"), F.ascii(c).alias("v")))
    return rasters.where(F.length(pixels) > 0).select(image, F.inline(codes))


def histogram(cells: DataFrame, image: str, names: DataFrame | None = None) -> DataFrame:
    """(image, v, n), or (image, name, n) with ``names`` (v, name); classes without cells do not come out."""
    n = cells.groupBy(image, "v").agg(F.count("*").alias("n"))
    return n if names is None else n.join(names, "v").select(image, "name", "n")


def absolute_difference(a: DataFrame, b: DataFrame, image: str) -> DataFrame:
    """(image, sad, n, moving): sum of absolute differences over common cells; moving if it is above 4 a cell."""
    both = a.join(b.withColumnRenamed("v", "_w"), [image, "x", "y"])
    sums = both.groupBy(image).agg(F.sum(F.abs(F.col("v") - F.col("_w"))).alias("sad"), F.count("*").alias("n"))
    return sums.withColumn("moving", F.col("sad") / F.col("n") > 4)


BLOCK = 32  # cells along a side of the blocks that a filter works in


def _spread(cells: DataFrame, image: str, radius: int) -> DataFrame:
    """Each cell sent to the cells around it, ``_dx`` and ``_dy`` away, within blocks of an image.

    Only the cells near the border of a block travel to more than one block; the spreading itself is done where the block is.
    """
    blocks = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - radius) / BLOCK), F.floor((F.col(c) + radius) / BLOCK), F.floor(F.col(c) / BLOCK))))
    placed = cells.withColumn("_bx", blocks("x")).withColumn("_by", blocks("y")).repartition(image, "_bx", "_by")
    steps = F.array(*[F.struct(F.lit(i).alias("_dx"), F.lit(j).alias("_dy")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    spread = placed.select("*", F.inline(steps)).withColumns({"x": F.col("x") + F.col("_dx"), "y": F.col("y") + F.col("_dy")})
    return spread.where((F.floor(F.col("x") / BLOCK) == F.col("_bx")) & (F.floor(F.col("y") / BLOCK) == F.col("_by")))


def _filtered(cells: DataFrame, image: str, radius: int, value: Column) -> DataFrame:
    """Each cell of ``cells`` with ``value`` aggregated over the cells around it, at the borders over fewer."""
    at_home = (F.col("_dx") == 0) & (F.col("_dy") == 0)
    own = [F.max(F.when(at_home, F.col("v"))).alias("v"), F.max(F.when(at_home, 1)).alias("_own")]
    # the blocks are among the keys, so the aggregation needs no shuffle of its own
    return _spread(cells, image, radius).groupBy(image, "_bx", "_by", "x", "y").agg(value.alias("filtered"), *own).where("_own is not null").select(image, "x", "y", "v", "filtered")


def box_blur(cells: DataFrame, image: str, radius: int = 1) -> DataFrame:
    return _filtered(cells, image, radius, F.avg("v"))


def median_filter(cells: DataFrame, image: str, radius: int = 2) -> DataFrame:
    return _filtered(cells, image, radius, upper_median("v", cells.schema["v"].dataType.simpleString()))


def replace_outliers(cells: DataFrame, image: str, limit: float, radius: int = 2) -> DataFrame:
    """Cells farther than ``limit`` from the median around them take it."""
    m = median_filter(cells, image, radius)
    return m.select(image, "x", "y", F.when(F.abs(F.col("v") - F.col("filtered")) > limit, F.col("filtered")).otherwise(F.col("v")).alias("v"))


def fill_invalid(cells: DataFrame, image: str, passes: int = 1) -> DataFrame:
    """Null cells take the mean of the valid ones around them, pass by pass."""
    for _ in range(passes):
        cells = box_blur(cells, image).select(image, "x", "y", F.coalesce("v", "filtered").alias("v"))
    return cells


def replace_far(points: DataFrame, best_x: float, best_y: float, limit: float = 400.0) -> DataFrame:
    """Displacements (dx, dy) farther than ``limit`` from the best take it."""
    far = F.sqrt(F.pow(F.col("dx") - best_x, 2) + F.pow(F.col("dy") - best_y, 2)) > limit
    return points.withColumns({"dx": F.when(far, best_x).otherwise(F.col("dx")), "dy": F.when(far, best_y).otherwise(F.col("dy"))})


def half_size(cells: DataFrame, image: str) -> DataFrame:
    """Each 2x2 block as its mean."""
    return cells.groupBy(image, F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.avg("v").alias("v"))


def local_contrast(cells: DataFrame, image: str, radius: int = 2, gain: float = 2.0) -> DataFrame:
    """Difference from the blur, amplified around 127.5 and held to 0..255."""
    b = box_blur(cells, image, radius)
    return b.select(image, "x", "y", F.least(F.greatest((F.col("v") - F.col("filtered")) * gain + 127.5, F.lit(0.0)), F.lit(255.0)).alias("v"))


def threshold(cells: DataFrame, limit: int) -> DataFrame:
    return cells.withColumn("v", F.when(F.col("v") >= limit, 255).otherwise(0))


def window_statistics(cells: DataFrame, image: str, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """(image, mean, deviation) inside a box, its far edges outside."""
    part = cells.where((F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2))
    return part.groupBy(image).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))


def mean_displacement(cells: DataFrame, image: str) -> DataFrame:
    """(image, dx, dy, n) over valid cells."""
    ok = lambda c: F.when(F.col("valid"), F.col(c))
    return cells.groupBy(image).agg(F.avg(ok("dx")).alias("dx"), F.avg(ok("dy")).alias("dy"), F.count(ok("dx")).alias("n"))


def argmax_class(scores: Column) -> Column:
    """The first class with the greatest score, from 0."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def tick_density(positions: DataFrame, position: str, total: int, slots: int = 2000) -> DataFrame:
    """(slot, n): how many of ``total`` positions fall in each slot of a slider."""
    slot = F.least(F.floor(F.col(position) * slots / total), F.lit(slots - 1)).cast("int")
    return positions.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))


def cluster_statistics(points: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n, cx, cy, tightness, alpha): mean distance to the centre; alpha weighs size against it."""
    centers = points.groupBy(cluster).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    off = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    stats = points.join(centers, cluster).groupBy(cluster, "cx", "cy").agg(F.count("*").alias("n"), F.avg(off).alias("tightness"))
    return stats.withColumn("alpha", F.col("n") / (F.col("tightness") + 0.1))


def best_cluster(points: DataFrame, cluster: str, share: float = 0.05) -> DataFrame:
    """The cluster of the greatest alpha among those with at least ``share`` of all points."""
    total = points.count()
    return cluster_statistics(points, cluster).where(F.col("n") >= share * total).orderBy(F.desc("alpha"), cluster).limit(1)


def kmeans(points: DataFrame, k: int = 5, iterations: int = 10, seed: int = 1) -> DataFrame:
    """``points`` with their ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=["x", "y"], outputCol="_xy").transform(points)
    return KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_xy", predictionCol="cluster").fit(table).transform(table).drop("_xy")


def fill_polygons(shapes: DataFrame, name: str, ring: str, width: int, height: int) -> DataFrame:
    """(name, x, y) of the cells whose centres are in a ring, each ring over its own bounding box only."""
    b = box_of(F.col(ring))
    low = lambda v: F.greatest(F.floor(v).cast("int"), F.lit(0))
    boxed = shapes.where(F.size(ring) >= 3).withColumns({"_x1": low(b["x1"]), "_y1": low(b["y1"]), "_x2": F.least(F.floor(b["x2"]).cast("int"), F.lit(width - 1)), "_y2": F.least(F.floor(b["y2"]).cast("int"), F.lit(height - 1))})
    rows = boxed.where("_x1 <= _x2 and _y1 <= _y2").withColumn("y", F.explode(F.sequence("_y1", "_y2")))
    cells = rows.withColumn("x", F.explode(F.sequence("_x1", "_x2")))
    return cells.where(inside(F.col("x") + 0.5, F.col("y") + 0.5, F.array(ring))).select(name, "x", "y")


# --- tile pyramid ---------------------------------------------------------------------------------------------------


def web_tiles(tiles: DataFrame, per_side: int = 4) -> DataFrame:
    """(z, x, y, sx, sy, modified): the web tiles each source tile is cut into."""
    parts = F.array(*[F.struct(F.lit(i).alias("sx"), F.lit(j).alias("sy")) for i in range(per_side) for j in range(per_side)])
    cut = tiles.select("z", F.col("x").alias("_x"), F.col("y").alias("_y"), "modified", F.inline(parts))
    return cut.select("z", (F.col("_x") * per_side + F.col("sx")).alias("x"), (F.col("_y") * per_side + F.col("sy")).alias("y"), "sx", "sy", "modified")


def pyramid(tiles: DataFrame, levels: int) -> DataFrame:
    """(z, x, y, modified) of the tiles and all their parents ``levels`` up; a parent is as new as its newest source."""
    up = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    every = tiles.select("*", up.alias("_up")).where(F.col("_up") <= F.col("z"))
    parent = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_up"))).cast("bigint")
    return every.groupBy((F.col("z") - F.col("_up")).alias("z"), parent("x").alias("x"), parent("y").alias("y")).agg(F.max("modified").alias("modified"))


def stale_tiles(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """Tiles not built yet, or built before a source changed."""
    old = built.select("z", "x", "y", F.col("modified").alias("_built"))
    return wanted.join(old, ["z", "x", "y"], "left").where(F.col("_built").isNull() | (F.col("_built") < F.col("modified"))).drop("_built")
