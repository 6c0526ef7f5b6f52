"""The annotation store: samples (whole images or regions), their labels, reports, edits, merges and video labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayledger.operators.crud import latest
from wayledger.operators.table import with_position
from wayledger.runtime import stage

EPOCH_MISSING = "2000-01-01 00:00:00"  # edit time of a frame that has none

# --- current state from the logs --------------------------------------------------------------------


def current_samples(log: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """The last version of each sample, by change time, then load time; without those deleted after their last load."""
    last = latest(log, ["id"], [F.col(c) for c in ("modified_at", "loaded_at", "image_path", "region_id", "region", "author")])
    if deletes is None:
        return last
    gone = deletes.groupBy("id").agg(F.max("deleted_at").alias("_gone"))
    loaded = log.groupBy("id").agg(F.max("loaded_at").alias("_loaded"))
    dead = gone.join(loaded, "id").where(F.col("_gone") > F.col("_loaded")).select("id")
    return last.join(dead, "id", "left_anti")


def current_labels(log: DataFrame) -> DataFrame:
    """The last version of each (sample_id, dimension); blank categories delete the label.

    A NaN intensity is null: a label database has no NaN, it stores null instead.
    """
    log = log.withColumn("intensity", F.nanvl("intensity", F.lit(None).cast("double")))
    last = latest(log, ["sample_id", "dimension"], [F.col(c) for c in ("modified_at", "loaded_at", "category", "intensity", "author")])
    return last.where(F.trim("category") != "")


# --- queries -----------------------------------------------------------------------------------------


def get_labels(samples: DataFrame, labels: DataFrame, image: str | None = None, dimension: str | None = None) -> DataFrame:
    """(image_path, region_id, region, dimension, category, intensity), optionally of one image or dimension."""
    if image:
        samples = samples.where(F.col("image_path") == image)
    if dimension:
        labels = labels.where(F.col("dimension") == dimension)
    rows = samples.select(F.col("id").alias("sample_id"), "image_path", "region_id", "region")
    return rows.join(labels.select("sample_id", "dimension", "category", "intensity"), "sample_id").drop("sample_id")


def labels_json(flat: DataFrame) -> DataFrame:
    """(image_path, region_id, body): {"region"?, "dims": {dimension: {category, intensity}}} of each region.

    Samples that claim the same region are one; of several labels of a dimension the greatest category counts. Regions
    and not images make the rows, for an image may have any number of regions, but a region has one label a dimension.
    """
    each = flat.groupBy("image_path", "region_id", "dimension").agg(F.max(F.struct("category", "intensity")).alias("v"), F.max("region").alias("region"))
    regions = each.groupBy("image_path", "region_id").agg(F.max("region").alias("region"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "v")))).alias("dims"))
    return regions.select("image_path", "region_id", F.to_json(F.struct(F.when(F.col("region") != "", F.col("region")).alias("region"), "dims")).alias("body"))


def folder_summary(samples: DataFrame, labels: DataFrame, prefix: str | None = None, dimension: str | None = None, distinct: bool = True) -> DataFrame:
    """Images with at least one label, of a folder, of a dimension; each once unless told otherwise."""
    if prefix:
        samples = samples.where(F.col("image_path").startswith(prefix))
    if dimension:
        labels = labels.where(F.col("dimension") == dimension)
    keyed = samples.select(F.col("id").alias("sample_id"), "image_path")
    if distinct:
        return keyed.join(labels.select("sample_id"), "sample_id", "left_semi").select("image_path").distinct()
    return keyed.join(labels.select("sample_id"), "sample_id").select("image_path")


def label_report(labels: DataFrame) -> DataFrame:
    return labels.groupBy("dimension", "category").agg(F.count("*").alias("n"))


def author_report(labels: DataFrame) -> DataFrame:
    """Labels per author, most first; a null author is ''."""
    return labels.groupBy(F.coalesce("author", F.lit("")).alias("author")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author")


def report_json(labels: DataFrame) -> DataFrame:
    """One row: {"dimensions": {d: {category: {"count"}}}, "authors": {a: {"count"}}}; its size is that of the vocabulary."""
    count = lambda c: F.struct(F.col(c).alias("count"))
    by_key = lambda key: lambda a, b: F.when(a[key] < b[key], -1).otherwise(1)
    dims = label_report(labels).groupBy("dimension").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", count("n"))))).alias("c"))
    dims = dims.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "c")), by_key("dimension")))).alias("d"), F.lit(None).cast("string").alias("a"))
    authors = author_report(labels).agg(F.lit(None).cast("string").alias("d"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("author", count("n")))))).alias("a"))
    return dims.unionByName(authors).agg(F.concat(F.lit('{"dimensions":'), F.max("d"), F.lit(',"authors":'), F.max("a"), F.lit("}")).alias("report"))


def next_region_id(samples: DataFrame) -> DataFrame:
    return samples.groupBy("image_path").agg((F.coalesce(F.max("region_id"), F.lit(0)) + 1).alias("next_region_id"))


def duplicate_regions(samples: DataFrame) -> DataFrame:
    """(image_path, region_id) that several samples claim."""
    return samples.groupBy("image_path", "region_id").agg(F.count("*").alias("n")).where("n > 1")


# --- regions -----------------------------------------------------------------------------------------


def region_points(region: str | Column) -> Column:
    """array<struct<x, y>> of '[[[x1,y1,x2,y2,...]]]' with at least three points; null for anything else."""
    c = F.col(region) if isinstance(region, str) else region
    inner = F.regexp_extract(c, r"^\s*\[\s*\[\s*\[([-+0-9.eE,\s]*)\]\s*\]\s*\]\s*$", 1)
    numbers = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(numbers) >= 6) & (F.size(numbers) % 2 == 0) & ~F.exists(numbers, lambda x: x.isNull())
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct(numbers[i * 2].alias("x"), numbers[i * 2 + 1].alias("y")))
    return F.when(good, points)


def region_bounds(points: Column) -> Column:
    xs, ys = points["x"], points["y"]
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def is_rectangle(points: Column) -> Column:
    """Four corners whose sides each change either x or y, not both."""
    n = F.size(points)
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (points[i]["x"] != points[(i + 1) % n]["x"]) != (points[i]["y"] != points[(i + 1) % n]["y"]))
    return F.coalesce((n == 4) & F.forall(steps, lambda s: s), F.lit(False))


def outside_image(samples: DataFrame, images: DataFrame) -> DataFrame:
    """Rectangular regions that reach beyond their image; ``images`` is (image_path, width, height)."""
    points = samples.withColumn("_p", region_points("region")).where(F.col("_p").isNotNull() & is_rectangle(F.col("_p"))).withColumn("_b", region_bounds(F.col("_p")))
    b = F.col("_b")
    return points.join(images, "image_path").where((b.x1 < 0) | (b.y1 < 0) | (b.x2 > F.col("width")) | (b.y2 > F.col("height"))).drop("_p", "_b")


# --- edits --------------------------------------------------------------------------------------------

DELETE, UPDATE, WHOLE_IMAGE, CREATE = "delete", "update", "whole image", "create"


def region_mode(region_id: Column, region: Column) -> Column:
    """What a command does: id and region tell delete, update, whole image and create apart."""
    has_id, has_region = F.coalesce(region_id, F.lit(0)) != 0, F.coalesce(region, F.lit("")) != ""
    return F.when(has_id & ~has_region, DELETE).when(has_id, UPDATE).when(has_region, CREATE).otherwise(WHOLE_IMAGE)


def check_commands(commands: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Commands with ``error``: null if they are fine."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    error = F.when(blank("image"), "image may not be empty").when(blank("dimension"), "dimension may not be empty").when(blank("author"), "author may not be empty")
    points = region_points("region")
    error = error.when(~blank("region") & points.isNull(), "region is broken")
    if images is not None:
        commands = commands.join(images.withColumnRenamed("image_path", "image"), "image", "left")
        b = region_bounds(points)
        error = error.when(is_rectangle(points) & ((b.x1 < 0) | (b.y1 < 0) | (b.x2 > F.col("width")) | (b.y2 > F.col("height"))), "region extends beyond the image")
    return commands.withColumn("error", error)


_MODES = {CREATE: 0, WHOLE_IMAGE: 1, UPDATE: 2, DELETE: 3}
_AFTER = "image string, region_id bigint, id bigint, fresh int, region string, author string, modified_at timestamp_ntz, label boolean, dimension string, category string, intensity double"


class _Image:
    """The regions and labels of one image while commands run over it."""

    def __init__(self) -> None:
        self.samples: dict[int, dict] = {}
        self.labels: dict[int, dict[str, dict]] = {}
        self.fresh = 0

    def store(self, r: dict) -> None:
        """A sample of the image, with its labels."""
        self.samples[r["id"]] = {c: r[c] for c in ("region_id", "region", "author", "modified_at")}
        self.labels[r["id"]] = {x["dimension"]: x for x in r["labels"]}

    def of_region(self, region_id: int) -> list[int]:
        """Samples of the region: those stored before by id, then new ones (numbered downwards from -1)."""
        return sorted((k for k, s in self.samples.items() if s["region_id"] == region_id), key=lambda k: (k < 0, abs(k)))

    def add(self, region_id: int, region: str | None, author: str | None, modified_at) -> None:
        self.fresh -= 1
        self.samples[self.fresh] = {"region_id": region_id, "region": region, "author": author, "modified_at": modified_at}
        self.labels[self.fresh] = {}

    def run(self, c: dict) -> None:
        region_id, mode = c["region_id"] or 0, c["mode"]
        if mode == CREATE:
            region_id = max([s["region_id"] for s in self.samples.values() if s["region_id"] is not None], default=0) + 1
            self.add(region_id, c["region"], c["author"], c["modified_at"])
        elif mode == WHOLE_IMAGE and not self.of_region(0):
            self.add(0, None, None, None)
        hit = self.of_region(region_id)
        if mode == UPDATE:
            for k in hit:
                self.samples[k] |= {"region": c["region"], "author": c["author"], "modified_at": c["modified_at"]}
        if mode == DELETE:
            for k in hit:
                del self.samples[k], self.labels[k]
        elif hit and c["category"]:
            self.labels[hit[0]][c["dimension"]] = {n: c[n] for n in ("dimension", "category", "intensity", "author", "modified_at")}
        elif hit:
            self.labels[hit[0]].pop(c["dimension"], None)

    def rows(self, image: str) -> Iterator[tuple]:
        for k, s in self.samples.items():
            of = (image, s["region_id"], k if k >= 0 else None, -k if k < 0 else None)
            yield (*of, s["region"], s["author"], s["modified_at"], False, None, None, None)
            for x in self.labels[k].values():
                yield (*of, None, x["author"], x["modified_at"], True, x["dimension"], x["category"], x["intensity"])


def _greatest_id(samples: DataFrame, labels: DataFrame) -> int:
    ids = samples.agg(F.max("id").alias("id")).unionByName(labels.agg(F.max("sample_id").alias("id")))
    return ids.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def set_labels(samples: DataFrame, labels: DataFrame, commands: DataFrame, order: tuple[str, ...] = ("modified_at",)) -> tuple[DataFrame, DataFrame]:
    """New (samples, labels) after good commands (image, region_id, region, dimension, category, intensity, author, modified_at).

    The commands are one micro-batch and run in turn, in the given order; commands of one place in it create first, then label whole images,
    update and delete, each by region and dimension. An empty category deletes the label; region modes are as in ``region_mode``. A new region takes the number after
    the greatest of its image at that moment. Commands on a region that is not there, or no more, change nothing.
    Where several samples claim a region, updates and deletes hit all of them, and the label goes to the one of the smallest id.
    New samples take the ids after the greatest of samples and labels, so none takes over labels that lead nowhere.

    Only the images that the batch names are touched, each by one task; all others pass by.
    """
    samples = samples.select("id", "image_path", "region_id", "region", "author", F.col("modified_at").cast("timestamp_ntz").alias("modified_at"))
    labels = labels.select("sample_id", "dimension", "category", "intensity", "author", F.col("modified_at").cast("timestamp_ntz").alias("modified_at"))
    c = commands.withColumn("mode", region_mode(F.col("region_id"), F.col("region"))).withColumn("modified_at", F.col("modified_at").cast("timestamp_ntz"))
    rank = F.create_map(*[F.lit(x) for item in _MODES.items() for x in item])[F.col("mode")]
    fields = ["image", "region_id", "region", "author", "modified_at", "mode", "dimension", "category", "intensity"]
    c = stage(c.select(*fields, F.struct(*order, rank.alias("rank"), "region", "dimension", "category").alias("turn")), "commands")
    named = c.select("image").distinct()
    touched = stage(samples.join(named, samples.image_path == named.image, "left_semi"), "touched")
    of_touched = labels.withColumnRenamed("sample_id", "id").join(touched.select("id"), "id", "left_semi")
    sets = of_touched.groupBy("id").agg(F.collect_list(F.struct("dimension", "category", "intensity", "author", "modified_at")).alias("labels"))  # one label a dimension
    states = touched.join(sets, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast(sets.schema["labels"].dataType))).withColumnRenamed("image_path", "image")
    turns = states.unionByName(c, allowMissingColumns=True).repartition("image").sortWithinPartitions("image", F.asc_nulls_first("turn")).drop("turn")
    columns = [x.split()[0] for x in _AFTER.split(", ")]
    arrow = pa.schema([(n, t) for n, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.timestamp("us"), pa.bool_(), pa.string(), pa.string(), pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, state = None, _Image()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["image"] != image:
                    out += state.rows(image)
                    image, state = row["image"], _Image()
                if row["mode"] is None:
                    state.store(row)
                else:
                    state.run(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), arrow.types)], schema=arrow) if out else pa.RecordBatch.from_pylist([], arrow)
        out = list(state.rows(image))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), arrow.types)], schema=arrow)

    after = stage(turns.mapInArrow(run, _AFTER), "after")
    start = _greatest_id(samples, labels)
    new = with_position(after.where("id is null and not label").select("image", "fresh"), ["image", "fresh"], "new").withColumn("new", F.col("new") + 1 + F.lit(start))
    after = after.join(new, ["image", "fresh"], "left").withColumn("id", F.coalesce("id", "new"))
    kept = samples.join(named, samples.image_path == named.image, "left_anti")
    changed = after.where("not label").select("id", F.col("image").alias("image_path"), "region_id", "region", "author", "modified_at")
    fields = labels.columns
    others = labels.join(touched.select(F.col("id").alias("sample_id")), "sample_id", "left_anti")
    return kept.unionByName(changed), others.unionByName(after.where("label").withColumnRenamed("id", "sample_id").select(*fields))


def merge_stores(samples: DataFrame, labels: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels of another store (image_path, dimension, category, author, modified_at) on whole images, with missing samples created."""
    whole = samples.where(F.col("region_id") == 0).groupBy("image_path").agg(F.min("id").alias("sample_id"))
    missing = source.join(whole, "image_path", "left_anti").groupBy("image_path").agg(F.min("author").alias("author"))
    top = _greatest_id(samples, labels)
    created = with_position(missing, ["image_path"], "_at").select((F.col("_at") + 1 + F.lit(top)).alias("id"), "image_path", "author")
    every = samples.unionByName(created.withColumn("region_id", F.lit(0).cast("long")), allowMissingColumns=True)
    ids = whole.unionByName(created.select("image_path", F.col("id").alias("sample_id")))
    new = latest(source, ["image_path", "dimension"], [F.col("modified_at"), F.col("category")]).join(ids, "image_path").drop("image_path")
    return every, labels.join(new.select("sample_id", "dimension"), ["sample_id", "dimension"], "left_anti").unionByName(new, allowMissingColumns=True)


# --- exports ------------------------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def export_plan(flat: DataFrame, root: str, target: str) -> DataFrame:
    """(source, target): one link per label, ``target/dimension/category/name_hash.ext``; the hash keeps equal names apart."""
    name = file_name(F.col("image_path"))
    stem, extension = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    digest = F.substring(F.md5("image_path"), 1, 16)
    return flat.select(
        F.concat(F.lit(root + "/"), "image_path").alias("source"),
        F.concat(F.concat_ws("/", F.lit(target), "dimension", "category", stem), F.lit("_"), digest, extension).alias("target"),
    )


def crop_plan(frame_labels: DataFrame, margin: int = 0) -> DataFrame:
    """(video, frame_us, class_name, left, top, width, height) of rectangles with an area."""
    left, top = F.least("x1", "x2") - margin, F.least("y1", "y2") - margin
    out = frame_labels.select("video", "frame_us", "class_name", left.alias("left"), top.alias("top"), (F.greatest("x1", "x2") + margin - left).alias("width"), (F.greatest("y1", "y2") + margin - top).alias("height"))
    return out.where("width > 0 and height > 0").distinct()


# --- video labels ---------------------------------------------------------------------------------------


def frames(rows: DataFrame) -> DataFrame:
    """(video, frame_us, labels) from one row per label; repeated rows count once."""
    corners = F.transform(F.split("poly", ","), lambda v: v.try_cast("int"))
    rect = F.when(F.col("x2") != F.col("x1"), F.struct("x1", "y1", "x2", "y2"))
    poly = F.when(F.size(corners) >= 6, corners)
    label = F.struct("class_name", "severity", "labeler", "edittime", rect.alias("rect"), poly.alias("poly"))
    return rows.groupBy("video", "frame_us").agg(F.array_sort(F.collect_set(label)).alias("labels"))


def flatten(frame_table: DataFrame) -> DataFrame:
    return frame_table.select("video", "frame_us", F.inline("labels"))


def class_counts(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Labels per class; with ``groups`` (class_name, group) per group, 'UNGROUPED:' + class where none is given."""
    counts = rows.groupBy("class_name").agg(F.count("*").alias("n"))
    if groups is None:
        return counts
    named = F.coalesce("group", F.concat(F.lit("UNGROUPED:"), "class_name"))
    return counts.join(groups, "class_name", "left").groupBy(named.alias("group")).agg(F.sum("n").alias("n"))


def class_index(rows: DataFrame) -> DataFrame:
    """(class_name, index) in the order of the names; as many rows as classes."""
    return rows.select("class_name").where("class_name is not null").distinct().withColumn("index", F.row_number().over(W.orderBy("class_name")) - 1)


def frame_totals(rows: DataFrame) -> DataFrame:
    """(n_labels, n_polygon_frames)."""
    has_poly = F.size(F.split("poly", ",")) >= 6
    per_frame = rows.groupBy("video", "frame_us").agg(F.count("*").alias("n"), F.max(F.coalesce(has_poly, F.lit(False))).alias("p"))
    return per_frame.agg(F.sum("n").alias("n_labels"), F.sum(F.col("p").cast("bigint")).alias("n_polygon_frames"))


def max_edit_time(rows: DataFrame) -> DataFrame:
    """Last edit of each frame; 2000-01-01 if no label has a time."""
    return rows.groupBy("video", "frame_us").agg(F.coalesce(F.max(F.timestamp_seconds("edittime")), F.to_timestamp(F.lit(EPOCH_MISSING))).alias("edited_at"))


def newer_frames(target: DataFrame, source: DataFrame) -> DataFrame:
    """(video, frame_us) of the frames that a merge takes from ``source``; their number is what it reports."""
    time = lambda rows, name: max_edit_time(rows).withColumnRenamed("edited_at", name)
    both = time(source, "s").join(time(target, "t"), ["video", "frame_us"], "left")
    return both.where(F.col("s") > F.coalesce("t", F.to_timestamp(F.lit(EPOCH_MISSING)))).select("video", "frame_us")


def find_frames(frame_table: DataFrame, times: DataFrame) -> DataFrame:
    """(video, frame_us, found, position) of each wanted (video, frame_us), once: whether there is a frame of that very time, and
    the number of frames of the video before it, which is where one would be put in."""
    frame = frame_table.select("video", "frame_us").distinct().withColumn("_n", F.lit(1)).withColumn("_wanted", F.lit(0))
    wanted = times.select("video", "frame_us").distinct().withColumn("_n", F.lit(0)).withColumn("_wanted", F.lit(1))
    every = frame.unionByName(wanted).groupBy("video", "frame_us").agg(F.max("_n").alias("_n"), F.max("_wanted").alias("_wanted"))
    before = F.sum("_n").over(W.partitionBy("video").orderBy("frame_us").rowsBetween(W.unboundedPreceding, -1))
    placed = every.withColumn("position", F.coalesce(before, F.lit(0)).cast("bigint"))
    return placed.where("_wanted = 1").select("video", "frame_us", (F.col("_n") == 1).alias("found"), "position")


def merge_frames(target: DataFrame, source: DataFrame) -> DataFrame:
    """Frames of ``target``, replaced where ``source`` is strictly newer, with newer frames only ``source`` has; empty frames drop out.

    Both are one row per label. A frame without edit times is as old as one edited at EPOCH_MISSING, and so is a frame that
    ``target`` lacks: it stays empty unless the source's is newer. A column ``origin`` tells where a frame's labels come from.
    """
    at = ["video", "frame_us"]
    newer = newer_frames(target, source)
    kept = target.join(newer, at, "left_anti").withColumn("origin", F.lit("target"))
    return kept.unionByName(source.join(newer, at, "left_semi").withColumn("origin", F.lit("source")))


def remove_empty_frames(frame_table: DataFrame) -> DataFrame:
    return frame_table.where(F.size("labels") > 0)


def merge_polygons(target: DataFrame, source: DataFrame) -> DataFrame:
    """Frames with the labels of the target and the polygons of the source appended; missing frames are copied."""
    polygons = source.select("video", "frame_us", F.filter("labels", lambda x: x["poly"].isNotNull()).alias("_p"), F.col("labels").alias("_all"))
    both = target.join(polygons, ["video", "frame_us"], "full_outer")
    return both.select("video", "frame_us", F.when(F.col("labels").isNull(), F.col("_all")).otherwise(F.concat("labels", F.coalesce("_p", F.array().cast(target.schema["labels"].dataType)))).alias("labels"))


def has_class(labels: Column, name: str) -> Column:
    return F.exists(labels, lambda x: x["class_name"] == name)


def severity_of(labels: Column, name: str) -> Column:
    """Severity of the first label of a class; -1 if there is none."""
    return F.coalesce(F.try_element_at(F.filter(labels, lambda x: x["class_name"] == name), F.lit(1))["severity"], F.lit(-1))


def without_class(labels: Column, name: str) -> Column:
    return F.filter(labels, lambda x: x["class_name"] != name)


def with_class(labels: Column, name: str, severity: int | None, labeler: str | None, edittime: int, like: Column) -> Column:
    """``labels`` with one label of the class, shaped like the struct ``like``, in place of others of the class."""
    label = like.withField("class_name", F.lit(name)).withField("severity", F.lit(severity).cast("int")).withField("labeler", F.lit(labeler).cast("string")).withField("edittime", F.lit(edittime).cast("bigint"))
    return F.array_append(without_class(labels, name), label)


def find_rect(labels: Column, x1: int, y1: int, x2: int, y2: int) -> Column:
    """Position of the label with this rectangle, from 0; -1 if there is none."""
    hit = F.transform(labels, lambda x: F.coalesce((x["rect"]["x1"] == x1) & (x["rect"]["y1"] == y1) & (x["rect"]["x2"] == x2) & (x["rect"]["y2"] == y2), F.lit(False)))
    return F.array_position(hit, True).cast("int") - 1


def edit_heat(edittime: Column, now: int) -> Column:
    """Age of an edit in units of five minutes, turned round: 1 just now, 0 from five minutes on."""
    return F.least(F.greatest(1 - (F.lit(now) - edittime) / F.lit(300.0), F.lit(0.0)), F.lit(1.0))


# --- taxonomies (dimension tables of a few hundred rows) -----------------------------------------------------


def taxonomy_indexes(taxonomy: DataFrame) -> DataFrame:
    """(key, class_name, is_polygon, patch_index, segmentation_index): patches count from 0, segments from 1 (0 is 'unlabeled')."""
    w = W.partitionBy("is_polygon").orderBy("key")
    n = F.row_number().over(w)
    return taxonomy.select("key", "class_name", "is_polygon", F.when(~F.col("is_polygon"), n - 1).alias("patch_index"), F.when(F.col("is_polygon"), n).alias("segmentation_index"))


def taxonomy_runs(taxonomy: DataFrame) -> DataFrame:
    """Runs of successive classes of one group: (run, group, first_key, n_classes)."""
    w = W.orderBy("key")
    starts = taxonomy.withColumn("_new", F.coalesce((F.col("group") != F.lag("group").over(w)).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("_new").over(w) - 1)
    return runs.groupBy("run", "group").agg(F.min("key").alias("first_key"), F.count("*").alias("n_classes"))


def taxonomy_json(taxonomy: DataFrame) -> DataFrame:
    """(group, classes): the classes of each group as JSON, in their order."""
    entry = F.struct("key", F.struct(F.col("class_name").alias("class"), "has_severity", "is_polygon").alias("e"))
    return taxonomy.groupBy("group").agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])).alias("classes"))


def category_names(metadata: DataFrame) -> DataFrame:
    """(version, names) of model metadata (part, version, categories map<string, int>): names by category number, versions joined by '-'."""
    names = F.transform(F.array_sort(F.transform(F.map_entries("categories"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))), lambda e: e["k"])
    return metadata.select("part", "version", names.alias("names"))
