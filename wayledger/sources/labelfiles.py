"""Label files of video frames, dimension files, photo lists and picture folders."""

from __future__ import annotations

import json
import os
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.operators.table import with_position

_FRAME = "edittime bigint, labels array<struct<classes:array<array<string>>,labeler:string,edittime:bigint,rect:struct<x1:int,y1:int,x2:int,y2:int>,poly:array<int>>>"


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(time, labels) of a folder of files named by their time in microseconds, in that order.

    A label's own edit time counts; in old files the frame's stands for it.
    """
    raw = spark.read.schema(_FRAME).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    time = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).try_cast("bigint")
    return raw.select(time.alias("time"), _labels_of(F.col("labels"), F.col("edittime")).alias("labels")).where("time is not null").orderBy("time")


def parse_frame(body: Column) -> Column:
    """The labels of the text of a frame's file."""
    frame = F.from_json(body, _FRAME)
    return _labels_of(frame["labels"], frame["edittime"])


def _labels_of(labels: Column, edittime: Column) -> Column:
    label = lambda x: F.struct(
        F.transform(x["classes"], lambda c: F.struct(c[0].alias("class"), F.try_element_at(c, F.lit(2)).try_cast("int").alias("severity"))).alias("classes"),
        x["labeler"].alias("labeler"), F.coalesce(x["edittime"], edittime).alias("edittime"),
        F.when(x["rect"]["x2"] != x["rect"]["x1"], x["rect"]).alias("rect"), F.when(F.size(x["poly"]) >= 6, x["poly"]).alias("poly"),
    )
    return F.transform(labels, label)


def frame_json(labels: Column) -> Column:
    """The text of a frame's file."""
    label = lambda x: F.struct(F.transform(x["classes"], lambda c: F.array(c["class"], c["severity"].cast("string"))).alias("classes"), x["labeler"].alias("labeler"), x["edittime"].alias("edittime"), x["rect"].alias("rect"), x["poly"].alias("poly"))
    return F.to_json(F.struct(F.transform(labels, label).alias("labels")))


def write_frames(frames: DataFrame, folder: str) -> None:
    """One file per frame, named by its time. A repeated task writes the same files again."""
    os.makedirs(folder, exist_ok=True)

    def write(rows) -> None:
        for r in rows:
            draft = f"{folder}/.{r.time}.{os.getpid()}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(r.body)
            os.replace(draft, f"{folder}/{r.time}.json")

    frames.select("time", frame_json(F.col("labels")).alias("body")).foreachPartition(write)


def read_dimensions(text: str) -> list[dict]:
    """Rows (dimension, explain, type, label, title, icon, has_intensity) of a dimension file.

    The values of a dimension are a list of labels or an object of properties by label; the older form has just the list.
    """
    rows = []
    for name, d in json.loads(text).items():
        spec = d if isinstance(d, dict) else {"values": d}
        values = spec.get("values", [])
        entries = values.items() if isinstance(values, dict) else ((v, {}) for v in values)
        for label, p in entries:
            text_label = str(int(label)) if isinstance(label, float) and label == int(label) else str(label)
            rows.append({"dimension": name, "explain": spec.get("explain", ""), "type": "polygon" if spec.get("type") == "polygon" else "whole", "label": text_label, "title": p.get("title", text_label), "icon": p.get("icon"), "has_intensity": bool(p.get("hasIntensity", False))})
    return rows


def sign_values(file_names: list[str]) -> dict[str, str]:
    """File name by sign code, the part before the first '_' or '.'; two files of one code are an error."""
    found: dict[str, str] = {}
    for name in file_names:
        code = name.split("_")[0].split(".")[0]
        if code in found:
            raise ValueError(f"{name} and {found[code]} have the same code")
        found[code] = name
    return found


_PHOTO = "Photo struct<URL:string>, Analysis struct<Models:map<string,struct<Count:map<string,int>,Version:string>>>"


def parse_photos(lists: DataFrame, column: str) -> DataFrame:
    """(url, models) of JSON lists of photos with their analyses."""
    photo = F.explode(F.from_json(column, f"array<struct<{_PHOTO.replace(' struct', ':struct')}>>"))
    return lists.select(photo.alias("p")).select(F.col("p.Photo.URL").alias("url"), F.col("p.Analysis.Models").alias("models"))


def not_analysed(photos: DataFrame, model: str, version: str) -> DataFrame:
    """Photos without an analysis of this version of a model."""
    return photos.where(~F.try_element_at("models", F.lit(model))["Version"].eqNullSafe(F.lit(version)))


def upload_batches(results: DataFrame, size: int = 8) -> DataFrame:
    """(batch, body): analyses (url, model, version, counts) as JSON, ``size`` photos a batch."""
    by_photo = results.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(F.col("version").alias("Version"), F.col("counts").alias("Count"))))).alias("Models"))
    batched = with_position(by_photo, ["url"], "_n").withColumn("batch", F.floor(F.col("_n") / size))
    photos = F.map_from_entries(F.collect_list(F.struct("url", F.struct("Models"))))
    return batched.groupBy("batch").agg(F.to_json(F.struct(photos.alias("Photos"))).alias("body"))


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(path, modified_at, length) of the pictures below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified_at"), "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*extensions)).orderBy("path")


def picture_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a JPEG or PNG, from its headers alone."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        elif marker == 1 or 0xD0 <= marker <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


@F.arrow_udf(_SIZE)
def picture_size_column(content: pa.Array) -> pa.Array:
    """``picture_size`` of a binary column."""
    sizes = [None if c is None else picture_size(c) for c in content.to_pylist()]
    return pa.array([s and {"width": s[0], "height": s[1]} for s in sizes], pa.struct([("width", pa.int32()), ("height", pa.int32())]))
