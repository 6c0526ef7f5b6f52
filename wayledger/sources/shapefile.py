"""Shapefiles (.shp with .dbf and .prj) as a data source, split into ranges of records by their index."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayledger.functions.wkt import GEOMETRY, geometry, order_rings
from wayledger.sources.dbf import local_path, read_header, read_records

RECORDS = 50_000
# shape type: kind, has z, has m
_TYPES = {1: ("point", 0, 0), 3: ("polyline", 0, 0), 5: ("polygon", 0, 0), 8: ("multipoint", 0, 0), 11: ("point", 1, 1), 13: ("polyline", 1, 1), 15: ("polygon", 1, 1), 18: ("multipoint", 1, 1), 21: ("point", 0, 1), 23: ("polyline", 0, 1), 25: ("polygon", 0, 1), 28: ("multipoint", 0, 1)}


def offsets(path: str) -> list[int]:
    """Where each record's header starts, in bytes; from the .shx file, else by walking the records."""
    index = path[:-4] + ".shx"
    if os.path.exists(index):
        with open(index, "rb") as f:
            data = f.read()[100:]
        return [2 * o for o, _ in struct.iter_unpack(">ii", data[: len(data) // 8 * 8])]
    found, at, end = [], 100, os.path.getsize(path)
    with open(path, "rb") as f:
        while at + 8 <= end:
            f.seek(at)
            found.append(at)
            at += 8 + 2 * struct.unpack(">ii", f.read(8))[1]
    return found


def shape(data: bytes, srid: int = 0) -> dict | None:
    """The geometry of a record's content; None for a null shape."""
    (code,) = struct.unpack_from("<i", data)
    if code == 0:
        return None
    kind, has_z, has_m = _TYPES[code]
    if kind == "point":
        n = 2 + has_z + has_m
        xy = [list(struct.unpack_from(f"<{n}d", data, 4))]
        return geometry(kind, [{"closed": False, "exterior": False, "xy": xy}], srid, "xy" + "z" * has_z + "m" * has_m)
    at = 36
    if kind == "multipoint":
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        starts = list(range(n))
    else:
        parts, n = struct.unpack_from("<ii", data, at)
        starts = list(struct.unpack_from(f"<{parts}i", data, at + 8))
        at += 8 + 4 * parts
    vertices = [list(v) for v in struct.iter_unpack("<dd", data[at : at + 16 * n])]
    at += 16 * n
    dims = "xy"
    for has, name in ((has_z, "z"), (has_m, "m")):
        if has and at + 16 + 8 * n <= len(data):  # the measures of a z type may be left out
            for v, extra in zip(vertices, struct.unpack_from(f"<{n}d", data, at + 16)):
                v.append(extra)
            at += 16 + 8 * n
            dims += name
    runs = [vertices[a:b] for a, b in zip(starts, [*starts[1:], n])]
    if kind == "polygon":
        rings = [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in runs]
        return geometry(kind, order_rings([r for r in rings if len(r) >= 3]), srid, dims)
    return geometry(kind, [{"closed": False, "exterior": False, "xy": r} for r in runs], srid, dims)


def srid_of(path: str) -> int:
    """SRID of the .prj file, for the two systems told apart by name; 0 otherwise."""
    try:
        with open(path[:-4] + ".prj", encoding="latin-1") as f:
            text = f.read()
    except OSError:
        return 0
    return 3857 if "Mercator" in text and "WGS" in text else 4326 if text.startswith("GEOGCS") and "WGS" in text else 0


@dataclass
class Range(InputPartition):
    first: int
    last: int


class ShapeSource(DataSource):
    """``spark.read.format('shp').load(path)``: the geometry first, then the fields of the table."""

    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> T.StructType:
        path = local_path(self.options["path"])
        fields = read_header(path[:-4] + ".dbf").schema().fields if os.path.exists(path[:-4] + ".dbf") else []
        return T.StructType([T.StructField("geometry", GEOMETRY), *fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ShapeReader(local_path(self.options["path"]))


class ShapeReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Range]:
        n = len(offsets(self.path))
        return [Range(i, min(n, i + RECORDS)) for i in range(0, max(n, 1), RECORDS)]

    def read(self, partition: Range) -> Iterator[tuple]:
        table = self.path[:-4] + ".dbf"
        header = read_header(table) if os.path.exists(table) else None
        rows = read_records(table, header, partition.first, partition.last, erased=True) if header else None
        srid = srid_of(self.path)
        with open(self.path, "rb") as f:
            for at in offsets(self.path)[partition.first : partition.last]:
                f.seek(at)
                length = struct.unpack(">ii", f.read(8))[1]
                g = shape(f.read(2 * length), srid)
                row = next(rows, None) if rows else ()
                if row is None:  # erased, with its shape
                    continue
                yield (g and (g["kind"], g["srid"], g["dims"], [(p["closed"], p["exterior"], p["xy"]) for p in g["parts"]]), *row)
