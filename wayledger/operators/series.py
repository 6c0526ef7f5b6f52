"""Tracks and other ordered series: as-of interpolation, speeds, sampling, filters, smoothing, simplification.

Everything is partitioned by track, so tracks run in parallel; what needs only neighbouring points cuts long tracks in time.
State machines and filters with memory fold over one track's points in order, a batch at a time: such a track is one task's work by nature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayledger.runtime import stage


def clean_track(points: DataFrame, track: str = "track_id", t: str = "dt", values: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    """(track, t, values): one point per time, the mean of those that share it; nulls drop out."""
    return points.where(F.col(t).isNotNull() & F.col(track).isNotNull()).groupBy(track, t).agg(*[F.avg(v).alias(v) for v in values])


PIECE_ROWS = 1_000_000  # points of a track that one task may sort; longer tracks are cut in time
SMALL_BYTES = 64 << 20  # input that Spark expects to be smaller is not looked through for long tracks; results are the same either way
PIECES = 10_000  # pieces that all tracks together are cut into at most, so their bounds are small


def pieces(points: DataFrame, track: str, t: str) -> DataFrame | None:
    """(track, bounds): the times at which tracks that are too long for one task are cut; None if there are none.

    A track is too long with more than PIECE_ROWS points and more than a PIECES-th of all points. The percentiles are
    exact to a tenth of a piece.
    """
    if int(str(points._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        return None
    sizes = points.groupBy(track).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    limit = max(PIECE_ROWS, total // PIECES)
    if total <= limit:
        return None
    long = [r._n for r in sizes.where(F.col("_n") > limit).select("_n").collect()]  # no more than PIECES
    if not long:
        return None
    bounds = None
    step = 2
    while step < 2 * -(-max(long) // limit):  # tracks of about as many pieces share a list of fractions
        here = sizes.where((F.col("_n") > limit * (step // 2)) & (F.col("_n") <= limit * step)).select(track)
        fractions = F.lit([k / step for k in range(1, step)])
        some = points.join(F.broadcast(here), track).groupBy(track).agg(F.array_distinct(F.percentile_approx(F.col(t).cast("double"), fractions, F.lit(10 * PIECES))).alias("_bounds"))
        bounds = some if bounds is None else bounds.unionByName(some)
        step *= 2
    return stage(bounds, "bounds")


def _cut(points: DataFrame, bounds: DataFrame, track: str, t: str) -> DataFrame:
    """``points`` with ``_piece``, the number of the piece of their track."""
    cut = points.join(F.broadcast(bounds), track, "left")  # at most PIECES bounds
    piece = F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")), lambda b: b < F.col(t)))
    return cut.withColumn("_piece", piece).drop("_bounds")


def with_neighbours(points: DataFrame, track: str, t: str, columns: tuple[str, ...], before: int = 1, after: int = 0) -> DataFrame:
    """``points`` with ``_p1``, ``_p2``, ... and ``_n1``, ``_n2``, ...: structs of ``columns`` of the points before and after.

    Times of a track are unique. Long tracks are cut in time and no task sorts a whole one: each
    piece gets the last points of the one before it and the first of the one behind it.
    """
    value = F.struct(*columns)
    names = [(f"_p{k}", F.lag, k) for k in range(1, before + 1)] + [(f"_n{k}", F.lead, k) for k in range(1, after + 1)]
    bounds = pieces(points, track, t)
    if bounds is None:
        w = W.partitionBy(track).orderBy(t)
        return points.withColumns({n: f(value, k).over(w) for n, f, k in names})
    cut = _cut(points, bounds, track, t).withColumn("_own", F.lit(True))
    # the ends of each piece go to the pieces next to it that are not empty: their numbers follow each other
    ends = cut.groupBy(track, "_piece").agg(*[f.alias(n) for n, f in (("_first", F.min(t)), ("_last", F.max(t)))])
    order = W.partitionBy(track).orderBy("_piece")
    near = ends.select(track, "_piece", F.lag("_piece").over(order).alias("_to_before"), F.lead("_piece").over(order).alias("_to_after"))
    edge = W.partitionBy(track, "_piece")
    place = cut.withColumns({"_up": F.row_number().over(edge.orderBy(t)), "_down": F.row_number().over(edge.orderBy(F.desc(t)))})
    lent = stage(place.where((F.col("_up") <= after) | (F.col("_down") <= before)), "edges").join(near, [track, "_piece"])
    for_next = lent.where((F.col("_down") <= before) & F.col("_to_after").isNotNull()).withColumn("_piece", F.col("_to_after"))
    for_last = lent.where((F.col("_up") <= after) & F.col("_to_before").isNotNull()).withColumn("_piece", F.col("_to_before"))
    every = cut
    for part in (for_next, for_last):
        every = every.unionByName(part.select(*[c for c in cut.columns if c != "_own"], F.lit(False).alias("_own")))
    w = W.partitionBy(track, "_piece").orderBy(t)
    return every.withColumns({n: f(value, k).over(w) for n, f, k in names}).where("_own").drop("_own", "_piece")


def segments(points: DataFrame, track: str, t: str, values: tuple[str, ...]) -> DataFrame:
    """(track, t1, t2, v1, v2 of each value) of successive points."""
    near = with_neighbours(points.select(track, t, *values), track, t, (t, *values), before=0, after=1).where("_n1 is not null")
    return near.select(track, F.col(t).alias("t1"), F.col("_n1")[t].alias("t2"), *[x for v in values for x in (F.col(v).alias(f"{v}1"), F.col("_n1")[v].alias(f"{v}2"))])


def steps(points: DataFrame, track: str = "track_id", t: str = "dt", values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``points`` with ``d`` and the name of each value: its change since the point before; null at the first."""
    near = with_neighbours(points, track, t, values)
    return near.withColumns({f"d{v}": F.col(v) - F.col("_p1")[v] for v in values}).drop("_p1")


def interpolate(points: DataFrame, times: DataFrame, track: str = "track_id", t: str = "dt", values: tuple[str, ...] = ("lon", "lat"), query: str = "qt") -> DataFrame:
    """(track, query, values, rate of each value): positions and velocities at the query times.

    Linear between the points around a time, at a point with the rate of the segment that ends there; up to the first
    and after the last point the value stays and the rate is 0.
    Points have unique times. Both sides are ordered together and swept once, so a query meets the
    nearest points without a range join.
    """
    null = F.lit(None).cast("double")
    both = points.select(track, F.col(t).cast("double").alias("_t"), F.lit(0).alias("_q"), *[F.col(v).cast("double").alias(v) for v in values]).unionByName(
        times.select(track, F.col(query).cast("double").alias("_t"), F.lit(1).alias("_q"), *[null.alias(v) for v in values]).distinct()
    )
    at = F.when(F.col("_q") == 0, F.struct("_t", *values))
    # a query lies in the segment that ends at it: points of its very time count to the right
    bounds = pieces(both, track, "_t")
    key = [track] if bounds is None else [track, "_piece"]
    if bounds is not None:
        both = _cut(both, bounds, track, "_t")
    before = W.partitionBy(*key).orderBy("_t", F.desc("_q")).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*key).orderBy(F.desc("_t"), "_q").rowsBetween(W.unboundedPreceding, 0)
    swept = both.select(*key, "_t", "_q", F.last(at, ignorenulls=True).over(before).alias("l"), F.last(at, ignorenulls=True).over(after).alias("r")).where("_q = 1")
    if bounds is not None:  # the nearest points of the pieces around
        ends = both.groupBy(*key).agg(F.max_by(at, F.when(F.col("_q") == 0, F.col("_t"))).alias("_last"), F.min_by(at, F.when(F.col("_q") == 0, F.col("_t"))).alias("_first"))
        order = W.partitionBy(track).orderBy("_piece")
        left_of, right_of = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
        near = ends.select(*key, F.last("_last", ignorenulls=True).over(left_of).alias("_l"), F.first("_first", ignorenulls=True).over(right_of).alias("_r"))
        swept = swept.join(near, key).withColumns({"l": F.coalesce("l", "_l"), "r": F.coalesce("r", "_r")})
    left, right = F.col("l"), F.col("r")
    share = (F.col("_t") - left["_t"]) / (right["_t"] - left["_t"])
    out = []
    for v in values:
        inner = F.when(right.isNull(), left[v]).when(left.isNull() | (right["_t"] == F.col("_t")), right[v]).otherwise(left[v] + share * (right[v] - left[v]))
        rate = F.when(left.isNull() | right.isNull(), F.lit(0.0)).otherwise((right[v] - left[v]) / (right["_t"] - left["_t"]))
        out += [inner.alias(v), rate.alias(f"{v}_rate")]
    return swept.where("l is not null or r is not null").select(track, F.col("_t").alias(query), *out)


def sample_times(points: DataFrame, interval: float, track: str = "track_id", t: str = "dt", query: str = "qt") -> DataFrame:
    """Times from the first to the last point of each track, ``interval`` apart."""
    ends = points.groupBy(track).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    steps = F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a")) / interval + 1e-9).cast("int"))
    return ends.select(track, "a", F.explode(steps).alias("i")).select(track, (F.col("a") + F.col("i") * interval).alias(query))


def speeds(points: DataFrame, track: str = "track_id", t: str = "dt", x: str = "x", y: str = "y") -> DataFrame:
    """(track, t, speed): length of the step to each point over its duration; the first point takes the second's."""
    near = with_neighbours(points.select(track, t, x, y), track, t, (t, x, y), before=1, after=1)
    own = F.struct(t, x, y)
    a, b = F.coalesce("_p1", own), F.when(F.col("_p1").isNull(), F.col("_n1")).otherwise(own)
    dx, dy, dt = b[x] - a[x], b[y] - a[y], b[t] - a[t]
    return near.select(track, t, (F.sqrt(dx * dx + dy * dy) / dt).alias("speed"))


def concatenate(points: DataFrame, recordings: DataFrame, track: str = "track_id", t: str = "dt") -> DataFrame:
    """One timeline: recordings (track, position) follow each other, each starting where the one before ended.

    ``recordings`` is a list of files, numbered; the offsets are a running sum over that list.
    """
    ends = points.groupBy(track).agg(F.max(t).alias("_end")).join(recordings, track)
    offsets = ends.select(track, F.coalesce(F.sum("_end").over(W.orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_offset"))
    return points.join(offsets, track).withColumn(t, F.col(t) + F.col("_offset")).drop("_offset")


def upper_median(column: str, kind: str = "double") -> Column:
    """Aggregate: the element at half the count of the sorted values, from 0, so the upper of the two middle ones.

    It is the lower median of the negated values. Counts of distinct values merge map-side; no values are
    gathered. ``upper_median_by`` and ``upper_median_of`` are for more distinct values than memory holds.
    """
    return F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{column}`)").cast(kind)


def upper_median_by(df: DataFrame, group: list[str], column: str, accuracy: int = 10_000) -> DataFrame:
    """(group, median): the upper median of each group of any size, exactly.

    A sketch brackets the middle of each group to a few ``accuracy``-ths of its rows; only values in the bracket are sorted, and
    their ranks follow from the number of values below it. Null and NaN values do not count; groups without others do not come out.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    values = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(column).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    edge = 2 / accuracy
    bracket = F.percentile_approx("_v", F.lit([max(0.0, 0.5 - edge), 0.5 + edge]), F.lit(accuracy))
    sized = values.groupBy(*keys).agg(F.count("*").alias("_n"), bracket.alias("_b")).select(*[F.col(k).alias(f"_s{k}") for k in keys], "_n", F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys])
    near = values.join(sized, same).withColumn("_in", F.when(F.col("_v") < F.col("_low"), F.lit(None).cast("double")).otherwise(F.col("_v"))).where(F.col("_v") <= F.col("_high"))
    counted = near.groupBy(*keys, "_n", "_in").agg(F.count("*").alias("_m"))  # the null counts what is below the bracket
    upto = F.sum("_m").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_in")))
    hit = counted.withColumn("_upto", upto).where((F.col("_upto") > F.floor(F.col("_n") / 2)) & (F.col("_upto") - F.col("_m") <= F.floor(F.col("_n") / 2)))
    return hit.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], F.col("_in").alias("median"))


def upper_median_of(df: DataFrame, column: str, bins: int = 4096) -> DataFrame:
    """One row: the upper median of a column of any size, exactly.

    The range is cut into bins and narrowed to the bin that holds the middle, until few values are left to sort.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    found = None
    if n:
        wanted, inside = n // 2, n
        while inside > 10_000 and high > low:
            width = (high - low) / bins
            if not width or low + width == low:
                break
            counts = values.where(F.col("v").between(low, high)).groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
            for r in counts:
                if wanted < r.n:
                    shrunk = r.n < inside or (r.lo, r.hi) != (low, high)
                    low, high, inside = r.lo, r.hi, r.n
                    break
                wanted -= r.n
            if not shrunk:
                break
        found = low if low == high else values.where(F.col("v").between(low, high)).orderBy("v").offset(wanted).limit(1).first()[0]
    return df.sparkSession.createDataFrame([(found,)], "median double")


def rolling_upper_median(df: DataFrame, track: str, order: list[str], column: str, rows: int, name: str) -> DataFrame:
    """Upper median of the last ``rows`` values of each row."""
    w = W.partitionBy(track).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.element_at(F.array_sort(F.collect_list(column).over(w)), (F.floor(F.count(column).over(w) / 2) + 1).cast("int")))


def heading(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def is_stopped(dx: Column, dy: Column, limit: float = 3.0) -> Column:
    return F.sqrt(dx * dx + dy * dy) < limit


def deviates(dx: Column, dy: Column, ax: Column, ay: Column, limit: float = 10.0) -> Column:
    """Whether the direction differs from (ax, ay) by more than ``limit`` degrees."""
    dot, cross = dx * ax + dy * ay, ax * dy - ay * dx
    return F.abs(F.degrees(F.atan2(cross, dot))) > limit


def running_average(df: DataFrame, track: str, order: list[str], value: str, rate: float, gate: float | None = None) -> DataFrame:
    """(track, average): exponential moving average at the end of each track, starting at its first value.

    Values of at least ``gate`` times the average so far do not count. The rows stream by; only the average is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, average, any_yet = None, None, False
        for batch in batches:
            out = []
            for k, v in zip(batch[track].tolist(), batch[value].tolist()):
                if not any_yet or k != key:
                    if any_yet:
                        out.append((key, average))
                    key, average, any_yet = k, v, True
                elif gate is None or v < average * gate:
                    average += rate * (v - average)
            yield pd.DataFrame(out, columns=[track, "average"])
        if any_yet:
            yield pd.DataFrame([(key, average)], columns=[track, "average"])

    rows = df.where(F.col(value).isNotNull()).select(track, *order, F.col(value).cast("double").alias(value))
    return rows.repartition(track).sortWithinPartitions(track, *order).select(track, value).mapInPandas(run, f"{track} {df.schema[track].dataType.simpleString()}, average double")


def scale_estimate(samples: DataFrame, gps_speed: str, pixels: str, fps: float, minimum_speed: float = 5.0, needed: int = 200) -> DataFrame:
    """One row (meters_per_pixel, n): upper median of gps speed over image speed; null with fewer than ``needed`` samples."""
    good = samples.where((F.col(gps_speed) >= minimum_speed) & (F.col(pixels) > 0)).select((F.col(gps_speed) / (F.col(pixels) * fps)).alias("r"))
    n = good.count()
    m = upper_median_of(good, "r")
    return m.select(F.when(F.lit(n) >= needed, F.col("median")).alias("meters_per_pixel"), F.lit(n).cast("bigint").alias("n"))


def quadratic_fit(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """(a, b, c, vertex) of the least-squares parabola, from power sums; null where three places are not told apart."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.groupBy(*(group or [])).agg(F.count(F.when(xs.isNotNull() & ys.isNotNull(), 1)).cast("double").alias("n"), *[F.sum(F.pow(xs, k)).alias(f"x{k}") for k in range(1, 5)], *[F.sum(F.pow(xs, k) * ys).alias(f"y{k}") for k in range(3)])
    c = {k: F.col(k) for k in ("n", "x1", "x2", "x3", "x4", "y0", "y1", "y2")}
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    rows = [[c["x4"], c["x3"], c["x2"]], [c["x3"], c["x2"], c["x1"]], [c["x2"], c["x1"], c["n"]]]
    right = [c["y2"], c["y1"], c["y0"]]
    whole = F.nullif(det(rows), F.lit(0.0))
    fit = [det([[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]) / whole for k in range(3)]
    out = sums.select(*(group or []), fit[0].alias("a"), fit[1].alias("b"), fit[2].alias("c"))
    return out.withColumn("vertex", -F.col("b") / F.nullif(2 * F.col("a"), F.lit(0.0)))


# --- state machines over one track ------------------------------------------------------------------------


def fold_track(points: DataFrame, track: str, order: list[str], make_state, step, schema: str) -> DataFrame:
    """Rows of each track in order through ``step(state, row) -> list of output tuples``.

    Tracks are hash-partitioned and sorted; a partition streams through in batches, and the state is the
    only thing kept between rows, so a track may be longer than memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if getattr(row, track) != key:
                    key, state = getattr(row, track), make_state()
                out += [(key, *x) for x in step(state, row)]
            yield pd.DataFrame(out, columns=names)

    return points.repartition(track).sortWithinPartitions(track, *order).mapInPandas(run, schema)


class _Emit:
    def __init__(self) -> None:
        self.at: tuple[float, float] | None = None


def emitted_frames(points: DataFrame, track: str = "track_id", t: str = "dt", x: str = "x", y: str = "y", speed: str = "speed", distance: float = 1.0, fast: float = 4.0) -> DataFrame:
    """(track, t) of the frames to emit: moved more than ``distance`` since the last one, or faster than ``fast``."""

    def step(state: _Emit, row) -> list[tuple]:
        px, py, v = getattr(row, x), getattr(row, y), getattr(row, speed)
        moved = state.at is None or math.hypot(px - state.at[0], py - state.at[1]) > distance
        if moved or (v is not None and v > fast):
            state.at = (px, py)
            return [(getattr(row, t),)]
        return []

    return fold_track(points.select(track, t, x, y, speed), track, [t], _Emit, step, f"{track} {points.schema[track].dataType.simpleString()}, {t} double")


class Motion:
    """State of the frames of one track so far."""

    def __init__(self) -> None:
        self.direction = self.bias = None
        self.diff = 0.0
        self.recent: list[tuple[float, float]] = []
        self.until_check = 0
        self.frame = 0
        self.resync = False


def motion_schema(key_type: str, track: str, t: str) -> str:
    return f"{track} {key_type}, {t} double, bias_x double, bias_y double, dir_x double, dir_y double, avg_diff double, resync boolean"


def motion_step(s: Motion, row, t: str, dx: str, dy: str, diff: str, ahead: float = 90.0, window: float = 45.0, interval: int = 100) -> list[tuple]:
    """The state after one frame, as rows of ``motion_schema`` without the track."""
    x, y, d = getattr(row, dx), getattr(row, dy), getattr(row, diff)
    size = math.hypot(x, y) or 0.01
    unit = (x / size, y / size)
    stopped, straight = size < 3.0, abs(math.degrees(math.atan2(y, x)) - ahead) < window
    did = False
    if s.frame == 0:
        # a first frame off the expected direction sets none
        s.direction, s.bias, s.diff = unit if straight else (0.0, 0.0), (x, y), d
    else:
        if s.until_check <= 0 or s.resync:
            s.until_check = interval
            near = all(math.hypot(x - a, y - b) <= 20 for a, b in s.recent)
            if math.hypot(x - s.bias[0], y - s.bias[1]) > 20 and d < s.diff:
                s.resync = True
            if s.resync and d < s.diff and near and len(s.recent) == 5:
                s.bias, s.resync, did = (x, y), False, True
            s.recent = [*s.recent, (x, y)][-5:]
        else:
            s.until_check -= 1
        cross, dot = s.direction[0] * y - s.direction[1] * x, s.direction[0] * x + s.direction[1] * y
        if abs(math.degrees(math.atan2(cross, dot))) > 10 and not stopped:
            s.until_check = min(s.until_check, 15)
        if straight and not stopped:
            s.direction = tuple(a + 0.005 * (u - a) for a, u in zip(s.direction, unit))
        if d < 2 * s.diff:
            s.bias = tuple(a + 0.15 * (v - a) for a, v in zip(s.bias, (x, y)))
            s.diff += 0.05 * (d - s.diff)
    s.frame += 1
    return [(getattr(row, t), *s.bias, *s.direction, s.diff, did)]


def motion_state(frames: DataFrame, track: str = "track_id", t: str = "dt", dx: str = "dx", dy: str = "dy", diff: str = "diff", **options) -> DataFrame:
    """(track, t, bias_x, bias_y, dir_x, dir_y, avg_diff, resync) after each frame.

    Moving averages of direction (rate 0.005), displacement (0.15) and image difference (0.05); displacement and difference
    learn only from frames whose difference is below twice the average. Every ``interval`` frames (100), or 15 after
    a deviation over 10 degrees, the raw displacement is checked. If it is off by more than 20 pixels in a good frame, checks
    go on until one agrees with the five before it within 20 pixels and replaces the average.
    """
    step = lambda s, row: motion_step(s, row, t, dx, dy, diff, **options)
    return fold_track(frames.select(track, t, dx, dy, diff), track, [t], Motion, step, motion_schema(frames.schema[track].dataType.simpleString(), track, t))


# --- geometry of a track ---------------------------------------------------------------------------------------


def _keep_simplified(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker: which points of a line stay."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        first, last = stack.pop()
        if last - first < 2:
            continue
        a, b, inner = xy[first], xy[last], xy[first + 1 : last]
        along = b - a
        length = float(along @ along)
        mu = np.clip((inner - a) @ along / length, 0, 1) if length else np.zeros(len(inner))
        off = inner - (a + mu[:, None] * along)
        far = (off * off).sum(axis=1)
        k = int(far.argmax())
        if far[k] > 0 and far[k] >= tolerance * tolerance:
            keep[first + 1 + k] = True
            stack += [(first, first + 1 + k), (first + 1 + k, last)]
    return keep


def simplify(points: DataFrame, tolerance: float, track: str = "track_id", t: str = "dt", x: str = "x", y: str = "y", piece: int = PIECE_ROWS) -> DataFrame:
    """The points of each track that stay when it is simplified to within ``tolerance`` (Ramer-Douglas-Peucker).

    A track of up to ``piece`` points is one task's work. Longer ones are split where the method splits them: the farthest
    point of an open segment is found by an aggregation, until no segment is longer. So the result does not depend on ``piece``.
    Times of a track are unique.
    """
    points = points.select(track, t, x, y)
    schema = points.schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        p = part.sort_values(t, kind="stable")
        return p[_keep_simplified(p[[x, y]].to_numpy(float), tolerance)][[track, t, x, y]]

    if points.groupBy(track).count().where(F.col("count") > piece).isEmpty():
        return points.groupBy(track).applyInPandas(run, schema)

    open_, kept = stage(points.withColumn("_from", F.lit(None).cast(schema[t].dataType)), "open"), None
    while True:
        key = [track, "_from"]  # a segment is named by its first time; its ends are in it
        ends = open_.groupBy(*key).agg(F.count("*").alias("_n"), F.min_by(F.struct(x, y), t).alias("_a"), F.max_by(F.struct(x, y), t).alias("_b"), F.min(t).alias("_t0"), F.max(t).alias("_t1"))
        ends = stage(ends.withColumnRenamed(track, "_track").withColumnRenamed("_from", "_seg"), "ends")
        same = open_[track].eqNullSafe(ends._track) & open_["_from"].eqNullSafe(ends._seg)
        if ends.where(F.col("_n") > piece).isEmpty():
            break
        small = ends.where(F.col("_n") <= piece)
        done = open_.join(small, same, "left_semi")
        rows = open_.join(ends.where(F.col("_n") > piece), same)
        ax, ay, bx, by = F.col("_a")[x], F.col("_a")[y], F.col("_b")[x], F.col("_b")[y]
        length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
        along = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(x) - ax) * (bx - ax) + (F.col(y) - ay) * (by - ay)) / length))).otherwise(0.0)
        ox, oy = F.col(x) - ax - along * (bx - ax), F.col(y) - ay - along * (by - ay)
        inner = F.when((F.col(t) > F.col("_t0")) & (F.col(t) < F.col("_t1")), ox * ox + oy * oy)
        rows = rows.withColumn("_far", inner)
        far = rows.groupBy(*key).agg(F.max(F.struct(F.coalesce("_far", F.lit(-1.0)).alias("d"), (-F.col(t)).alias("t"))).alias("_m"))
        far = far.select(F.col(track).alias("_k"), F.col("_from").alias("_f"), F.col("_m.d").alias("_d"), (-F.col("_m.t")).alias("_at"))
        rows = rows.join(far, rows[track].eqNullSafe(far._k) & rows["_from"].eqNullSafe(far._f)).drop("_k", "_f")
        split = (F.col("_d") > 0) & (F.col("_d") >= F.lit(float(tolerance) ** 2))
        at_end = (F.col(t) == F.col("_t0")) | (F.col(t) == F.col("_t1"))
        flat = rows.where(~split & at_end).select(track, t, x, y)
        kept = flat if kept is None else kept.unionByName(flat)
        # the point of the split ends one half and begins the other
        both = F.when(F.col(t) < F.col("_at"), F.array("_from")).when(F.col(t) > F.col("_at"), F.array("_at")).otherwise(F.array("_from", "_at"))
        halves = rows.where(split).withColumn("_next", F.explode(both)).select(track, t, x, y, F.col("_next").alias("_from"))
        open_ = stage(halves.unionByName(done.select(*halves.columns)), "open")
    rest = open_.groupBy(track, "_from").applyInPandas(run, schema)
    return (rest if kept is None else rest.unionByName(kept)).distinct()


def _control_points(p0: np.ndarray, p1: np.ndarray, p2: np.ndarray, smoothness: float) -> tuple[np.ndarray, np.ndarray]:
    d01, d12 = np.linalg.norm(p1 - p0), np.linalg.norm(p2 - p1)
    whole = d01 + d12
    if not whole:
        return p1, p1
    return p1 - smoothness * d01 / whole * (p2 - p0), p1 + smoothness * d12 / whole * (p2 - p0)


def _curve(before: np.ndarray | None, p0: np.ndarray, p1: np.ndarray, p2: np.ndarray, t0: float, t1: float, smoothness: float, increment: float) -> list[tuple[float, float, float]]:
    """(t, x, y) of the points after p0 up to p1, on the curve through p0 and p1 among their neighbours."""
    length = float(np.linalg.norm(p1 - p0))
    if length < increment:
        return [(t1, *p1)]
    leaving = p1 if before is None else _control_points(before, p0, p1, smoothness)[1]
    arriving = _control_points(p0, p1, p2, smoothness)[0]
    u = np.linspace(0, 1, int(max(2.0, length / increment)) + 1)[:, None]
    curve = (1 - u) ** 3 * p0 + 3 * (1 - u) ** 2 * u * leaving + 3 * (1 - u) * u**2 * arriving + u**3 * p1
    curve[-1] = p1
    steps = np.linalg.norm(np.diff(curve, axis=0), axis=1)
    times = t0 + np.cumsum(steps) / steps.sum() * (t1 - t0)
    return list(zip(times.tolist(), curve[1:, 0].tolist(), curve[1:, 1].tolist()))


def smooth(points: DataFrame, smoothness: float, increment: float, track: str = "track_id", t: str = "dt", x: str = "x", y: str = "y") -> DataFrame:
    """Points on Bezier curves through each track, about ``increment`` apart, at constant speed between two of its points.

    A segment's curve depends on the point before it and the one behind it only, so segments are rows and any task can do any.
    """
    at = with_neighbours(points.select(track, t, x, y), track, t, (t, x, y), before=1, after=2)
    near = {f"{n}{i}": F.col(where)[c] for n, c in (("x", x), ("y", y)) for i, where in (("b1", "_p1"), ("1", "_n1"), ("2", "_n2"))}
    rows = at.select(track, F.col(t).cast("double").alias("t0"), F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"), F.col("_n1")[t].cast("double").alias("t1"), *[c.cast("double").alias(n) for n, c in near.items()])
    schema = f"{track} {points.schema[track].dataType.simpleString()}, {t} double, {x} double, {y} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                key, p0 = r[0], np.array([r.x0, r.y0])
                first = math.isnan(r.xb1)
                if first:
                    out.append((key, r.t0, *p0))
                if not math.isnan(r.t1):
                    p1 = np.array([r.x1, r.y1])
                    p2 = p1 if math.isnan(r.x2) else np.array([r.x2, r.y2])
                    out += [(key, *c) for c in _curve(None if first else np.array([r.xb1, r.yb1]), p0, p1, p2, r.t0, r.t1, smoothness, increment)]
            yield pd.DataFrame(out, columns=[track, t, x, y])

    return rows.mapInPandas(run, schema)
