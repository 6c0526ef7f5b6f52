"""Plane geometry as column expressions: points, segments, rings, boxes, tiles, projections, perspective.

A ring is an array of structs with x and y, its closing point not repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
HALF_WORLD = 20037508.3427892430766  # metres from the middle to the edge of Web Mercator
TILE = 1024


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def closest_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, segment: bool = True) -> Column:
    """Where along the line from a to b the point closest to p lies: 0 at a, 1 at b; 0 if a and b are one."""
    dx, dy = bx - ax, by - ay
    mu = F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(mu, F.lit(0.0)), F.lit(1.0)) if segment else mu


def closest_point(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, segment: bool = True) -> Column:
    mu = closest_fraction(px, py, ax, ay, bx, by, segment)
    return F.struct((ax + mu * (bx - ax)).alias("x"), (ay + mu * (by - ay)).alias("y"), mu.alias("mu"))


def side_of_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Positive on the left of the line from a to b, negative on the right, 0 on it."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def edges(ring: Column) -> Column:
    """array<struct<ax, ay, bx, by>> with the closing edge."""
    n = F.size(ring)
    e = lambda i: F.struct(ring[i]["x"].alias("ax"), ring[i]["y"].alias("ay"), ring[(i + 1) % n]["x"].alias("bx"), ring[(i + 1) % n]["y"].alias("by"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), e))


def signed_area(ring: Column) -> Column:
    """Positive if counter-clockwise. Coordinates are taken from the first point, for precision."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    return F.aggregate(edges(ring), F.lit(0.0), lambda a, e: a + ((e["ax"] - x0) * (e["by"] - y0) - (e["bx"] - x0) * (e["ay"] - y0)) / 2)


def area(rings: Column) -> Column:
    """Of a polygon as array<struct<exterior boolean, ring>>: exterior rings less interior ones."""
    return F.aggregate(rings, F.lit(0.0), lambda a, r: a + F.when(F.coalesce(r["exterior"], F.lit(True)), F.abs(signed_area(r["ring"]))).otherwise(-F.abs(signed_area(r["ring"]))))


def orientation(ring: Column) -> Column:
    return F.when(F.size(ring) < 3, "invalid").when(signed_area(ring) > 0, "ccw").when(signed_area(ring) < 0, "cw").otherwise("invalid")


def inside(px: Column, py: Column, rings: Column) -> Column:
    """Whether a point is in a polygon, by the even-odd rule over all rings (array of rings)."""

    def crossings(ring):
        def crosses(e):
            spans = (e["ay"] > py) != (e["by"] > py)
            at = e["ax"] + (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) * (e["bx"] - e["ax"])
            return F.coalesce((spans & (px < at)).cast("int"), F.lit(0))

        return F.aggregate(edges(ring), F.lit(0), lambda a, e: a + crosses(e))

    return F.aggregate(rings, F.lit(0), lambda a, r: a + crossings(r)) % 2 == 1


def snap(px: Column, py: Column, line: Column) -> Column:
    """struct<distance, x, y, position>: the closest point of a line (array of points); position counts vertices and fractions between them."""

    def at(i):
        a, b = line[i], line[i + 1]
        c = closest_point(px, py, a["x"], a["y"], b["x"], b["y"])
        return F.struct(F.sqrt(F.pow(c["x"] - px, 2) + F.pow(c["y"] - py, 2)).alias("distance"), (i + c["mu"]).alias("position"), c["x"].alias("x"), c["y"].alias("y"))

    return F.when(F.size(line) >= 2, F.array_min(F.transform(F.sequence(F.lit(0), F.size(line) - 2), at)))


def point_at(line: Column, position: Column) -> Column:
    """The point at a position as ``snap`` gives it, held to the line's ends."""
    p = F.least(F.greatest(position, F.lit(0.0)), (F.size(line) - 1).cast("double"))
    i = F.least(F.floor(p).cast("int"), F.size(line) - 2)
    a, b, mu = line[i], line[i + 1], p - i
    return F.struct((a["x"] + mu * (b["x"] - a["x"])).alias("x"), (a["y"] + mu * (b["y"] - a["y"])).alias("y"))


# --- boxes: structs with x1, y1, x2, y2 ---------------------------------------------------------------------


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """With its corners in order."""
    return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))


def box_overlaps(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def box_contains(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))


def box_clip(a: Column, b: Column) -> Column:
    """The common part; null if there is none."""
    common = F.struct(F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"), F.least(a["x2"], b["x2"]).alias("x2"), F.least(a["y2"], b["y2"]).alias("y2"))
    return F.when(box_overlaps(a, b), common)


def box_center(a: Column) -> Column:
    return point((a["x1"] + a["x2"]) / 2, (a["y1"] + a["y2"]) / 2)


def box_of(points: Column) -> Column:
    xs, ys = points["x"], points["y"]
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


# --- curves --------------------------------------------------------------------------------------------------------


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Bits of x and y interleaved, x lowest."""
    step = lambda a, i: a.bitwiseOR(_shifted(x, i, 2 * i)).bitwiseOR(_shifted(y, i, 2 * i + 1))
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        out = step(out, i)
    return out


def _shifted(v: Column, bit: int, to: int) -> Column:
    return F.shiftleft(F.shiftright(v.cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint")), to)


def hilbert(x: Column, y: Column, bits: int) -> Column:
    """Place along the Hilbert curve that goes down, right and up: (0, top) first, (0, 0) at a quarter."""
    side = 1 << bits
    zero = F.lit(0).cast("bigint")
    start = F.struct(x.cast("bigint").alias("x"), (F.lit(side - 1) - y.cast("bigint")).alias("y"), zero.alias("d"))

    def step(a, s):
        rx, ry = (a["x"].bitwiseAND(s) > 0).cast("bigint"), (a["y"].bitwiseAND(s) > 0).cast("bigint")
        d = a["d"] + s * s * F.when(rx == 1, 3 - ry).otherwise(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, F.lit(side - 1) - a["x"]).otherwise(a["x"]), F.when(flip, F.lit(side - 1) - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    levels = F.array(*[F.lit(1 << i).cast("bigint") for i in reversed(range(bits))])
    return F.aggregate(levels, start, step, lambda a: a["d"])


def sierpinski(x: Column, y: Column, top: int) -> Column:
    """Place along the Sierpinski curve over the square 0..top: two triangles, each halved again and again."""
    m = F.lit(top).cast("bigint")
    x, y = x.cast("bigint"), y.cast("bigint")
    lower = x > y
    start = F.struct(F.when(lower, m - x).otherwise(x).alias("x"), F.when(lower, m - y).otherwise(y).alias("y"), lower.cast("bigint").alias("d"))

    def step(a, _):
        far = a["x"] + a["y"] > m
        px, py = F.when(far, m - a["y"]).otherwise(a["x"]) * 2, F.when(far, a["x"]).otherwise(a["y"]) * 2
        d = (a["d"] * 2 + far.cast("bigint")) * 2
        high = py > m
        return F.struct(F.when(high, py - m).otherwise(px).alias("x"), F.when(high, m - px).otherwise(py).alias("y"), (d + high.cast("bigint")).alias("d"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, top.bit_length()))), start, step, lambda a: a["d"])


# --- projections and tiles ---------------------------------------------------------------------------------------


def mercator(lon: Column, lat: Column) -> Column:
    """Web Mercator metres, x to the east and y to the north."""
    return point(F.radians(lon) * EARTH_RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS)


def from_mercator(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(x / EARTH_RADIUS).alias("lon"), F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - math.pi / 2).alias("lat"))


def map_position(lon: Column, lat: Column) -> Column:
    """Web Mercator metres from the upper left corner of the world, y to the south."""
    m = mercator(lon, lat)
    return point(m["x"] + HALF_WORLD, HALF_WORLD - m["y"])


def zoom_level(meters_per_pixel: Column) -> Column:
    return F.floor(F.log2(F.lit(2 * math.pi * EARTH_RADIUS / 256) / meters_per_pixel)).cast("int")


def round_down(x: Column, unit: int) -> Column:
    return (F.floor(x / unit) * unit).cast("bigint")


def round_up(x: Column, unit: int) -> Column:
    return (F.ceil(x / unit) * unit).cast("bigint")


# --- perspective: a flat plane seen by a tilted camera --------------------------------------------------------------


def flat_to_camera(x: Column, y: Column, z1: Column, zx: Column, zy: Column, width: int = 0, height: int = 0) -> Column:
    z = z1 + zx * x + zy * y
    return point(x / z + width // 2, y / z + height // 2)


def camera_to_flat(u: Column, v: Column, z1: Column, zx: Column, zy: Column, width: int = 0, height: int = 0) -> Column:
    """The inverse of ``flat_to_camera``."""
    u, v = u - width // 2, v - height // 2
    scale = z1 / (1 - zx * u - zy * v)
    return point(u * scale, v * scale)


def frustum(width: int, height: int, z1: Column, zx: Column, zy: Column) -> Column:
    """struct<width, height, x1, x2>: size of the flattened frame and where its bottom edge lies."""
    corner = lambda u, v: camera_to_flat(F.lit(float(u)), F.lit(float(v)), z1, zx, zy, width, height)
    a, b, c, d = corner(0, 0), corner(width, 0), corner(0, height), corner(width, height)
    return F.struct((b["x"] - a["x"]).cast("int").alias("width"), (c["y"] - a["y"]).cast("int").alias("height"), c["x"].alias("x1"), d["x"].alias("x2"))


def newton(start: float, step: float, wanted: Column, f, precision: float, iterations: int) -> Column:
    """x with f(x) near ``wanted``: Newton's method with numeric slopes, all in one expression."""

    def move(a, _):
        y, slope = f(a), (f(a + step) - f(a - step)) / (2 * step)
        return F.when((F.abs(y - wanted) <= precision) | (slope == 0), a).otherwise(a - (y - wanted) / slope)

    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.lit(start), move)


def scale_at_bottom(width: int, height: int, zx: Column, zy: Column) -> Column:
    """The z1 at which the bottom edge of the flattened frame is as wide as the frame."""

    def ratio(z1):
        f = frustum(width, height, z1, zx, zy)
        return (f["x2"] - f["x1"]) / width

    return newton(1.0, 0.001, F.lit(1.0), ratio, 1e-6, 10)
