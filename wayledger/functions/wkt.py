"""Geometries as structs, and their text (WKT), binary (WKB, EWKB) and JSON forms.

A geometry has a kind (point, multipoint, polyline, polygon), an SRID, its dimensions (xy, xyz, xym or xyzm)
and parts. A part is a run of vertices; the closing vertex of a ring is not repeated. In a polygon
each exterior ring (counter-clockwise) is followed by its holes (clockwise).
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.functions.geometry import area, inside

PART = T.StructType([T.StructField("closed", T.BooleanType()), T.StructField("exterior", T.BooleanType()), T.StructField("xy", T.ArrayType(T.ArrayType(T.DoubleType())))])
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("srid", T.IntegerType()), T.StructField("dims", T.StringType()), T.StructField("parts", T.ArrayType(PART))])

Ring = list[list[float]]
_KINDS = {"POINT": "point", "MULTIPOINT": "multipoint", "LINESTRING": "polyline", "MULTILINESTRING": "polyline", "POLYGON": "polygon", "MULTIPOLYGON": "polygon"}
_HEAD = re.compile(r"^\s*(?:SRID=(-?\d+);)?\s*(MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|POINT|LINESTRING|POLYGON)\s*(ZM|Z|M)?\s*(EMPTY\s*$|\()", re.IGNORECASE)


class GeometryError(ValueError):
    """Text or bytes that are no geometry."""


def signed_area(ring: Ring) -> float:
    x0, y0 = ring[0][:2]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def contains(ring: Ring, x: float, y: float) -> bool:
    inside = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            inside = not inside
    return inside


def _part(xy: Ring, closed: bool = False, exterior: bool = False) -> dict:
    return {"closed": closed, "exterior": exterior, "xy": xy}


def _open(ring: Ring) -> Ring:
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def geometry(kind: str, parts: list[dict], srid: int = 0, dims: str = "xy") -> dict:
    return {"kind": kind, "srid": srid, "dims": dims, "parts": parts}


# --- rings ----------------------------------------------------------------------------------------------


def ring_parents(rings: list[Ring], largest: bool = False) -> list[int]:
    """For each ring the smallest ring around it, or the largest, -1 if none. A larger ring is inside no smaller one, so there is no circle."""
    sizes = [abs(signed_area(r)) for r in rings]
    boxes = [(min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)) for r in rings]
    parents = []
    for i, ring in enumerate(rings):
        around = [
            j
            for j, b in enumerate(boxes)
            if j != i and (sizes[j], j) > (sizes[i], i) and b[0] <= boxes[i][0] and b[1] <= boxes[i][1] and b[2] >= boxes[i][2] and b[3] >= boxes[i][3] and contains(rings[j], *ring[0][:2])
        ]
        parents.append((max if largest else min)(around, key=sizes.__getitem__, default=-1))
    return parents


def ring_levels(rings: list[Ring]) -> list[int]:
    """How many rings are around each ring."""
    parents = ring_parents(rings)
    levels = []
    for i in range(len(rings)):
        n, at = 0, parents[i]
        while at >= 0:
            n, at = n + 1, parents[at]
        levels.append(n)
    return levels


def order_rings(rings: list[Ring]) -> list[dict]:
    """Parts of a polygon: exterior rings counter-clockwise, each before the rings in it, which run clockwise.

    A ring in others belongs to the largest of them, so rings in holes are no exterior rings but go with the outermost one.
    """
    parents = ring_parents(rings, largest=True)
    turned = lambda r, ccw: r if (signed_area(r) > 0) == ccw else [r[0], *r[:0:-1]]
    out = []
    for i, ring in enumerate(rings):
        if parents[i] < 0:
            out.append(_part(turned(ring, True), True, True))
            out += [_part(turned(r, False), True, False) for j, r in enumerate(rings) if parents[j] == i]
    return out


def to_polygon(g: dict) -> dict:
    """A polyline as a polygon; parts of fewer than three vertices drop out."""
    rings = [_open(p["xy"]) for p in g["parts"]]
    return {**g, "kind": "polygon", "parts": order_rings([r for r in rings if len(r) >= 3])}


def to_polyline(g: dict) -> dict:
    """A polygon as the lines around it."""
    return {**g, "kind": "polyline", "parts": [_part([*p["xy"], p["xy"][0]] if p["closed"] else p["xy"]) for p in g["parts"]]}


def with_dims(g: dict, dims: str, fill: float = 0.0) -> dict:
    """With other dimensions: new ones filled, missing ones dropped."""
    at = {c: i for i, c in enumerate(g["dims"])}
    move = lambda v: [v[at[c]] if c in at else fill for c in dims]
    return {**g, "dims": dims, "parts": [{**p, "xy": [move(v) for v in p["xy"]]} for p in g["parts"]]}


# --- text ---------------------------------------------------------------------------------------------------


def parse_wkt(text: str) -> dict:
    head = _HEAD.match(text)
    if not head:
        raise GeometryError(f"no geometry: {text[:40]!r}")
    word, dims = head.group(2).upper(), "xy" + (head.group(3) or "").lower()
    srid, kind = int(head.group(1) or 0), _KINDS[head.group(2).upper()]
    if head.group(4).strip().upper() == "EMPTY":
        return geometry(kind, [], srid, dims)
    body = text[head.end() - 1 :]
    if re.search(r"[^-+0-9.eE,()\s]", body):
        raise GeometryError("unexpected characters")
    bracketed = re.sub(r"([-+0-9.eE]+(?:\s+[-+0-9.eE]+)*)", lambda m: "[" + ",".join(m.group(1).split()) + "]", body)
    try:
        tree = json.loads(re.sub(r"(?<![\d.])([+-]?)\.(\d)", r"\g<1>0.\2", bracketed.replace("(", "[").replace(")", "]").replace("+", "")).replace(".]", ".0]").replace(".,", ".0,"))
    except ValueError:
        raise GeometryError("unbalanced or broken numbers") from None
    flat = lambda v: v[0] if v and isinstance(v[0], list) else v
    if word == "POINT":
        lists = [[tree[0]]]
    elif word == "MULTIPOINT":
        lists = [[flat(p)] for p in tree]
    elif word == "LINESTRING":
        lists = [tree]
    elif word in ("MULTILINESTRING", "POLYGON"):
        lists = tree
    else:
        lists = [ring for polygon in tree for ring in polygon]
    if any(not isinstance(v, list) or len(v) != len(dims) for part in lists for v in part):
        raise GeometryError(f"a vertex has {len(dims)} numbers")
    lists = [[[float(x) for x in v] for v in part] for part in lists]
    if kind == "polygon":
        return geometry(kind, order_rings([r for r in map(_open, lists) if len(r) >= 3]), srid, dims)
    return geometry(kind, [_part(p) for p in lists], srid, dims)


def _number(x: float) -> str:
    return repr(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _polygons(g: dict) -> list[list[Ring]]:
    out: list[list[Ring]] = []
    for p in g["parts"]:
        ring = [*p["xy"], p["xy"][0]]
        if p["exterior"] or not out:
            out.append([ring])
        else:
            out[-1].append(ring)
    return out


def write_wkt(g: dict, srid: bool = False, multi: bool = False) -> str:
    vertices = lambda part: "(" + ", ".join(" ".join(map(_number, v)) for v in part) + ")"
    mark = g["dims"][2:].upper()
    name = lambda word: word + (f" {mark}" if mark else "")
    kind, parts = g["kind"], [p["xy"] for p in g["parts"]]
    head = f"SRID={g['srid']};" if srid and g["srid"] else ""
    if not parts:
        return head + name({"point": "POINT", "multipoint": "MULTIPOINT", "polyline": "LINESTRING", "polygon": "POLYGON"}[kind]) + " EMPTY"
    if kind == "point":
        return head + name("POINT") + vertices(parts[0])
    if kind == "multipoint":
        return head + name("MULTIPOINT") + "(" + ", ".join(vertices(p) for p in parts) + ")"
    if kind == "polyline":
        return head + (name("LINESTRING") + vertices(parts[0]) if len(parts) == 1 and not multi else name("MULTILINESTRING") + "(" + ", ".join(map(vertices, parts)) + ")")
    polygons = ["(" + ", ".join(map(vertices, rings)) + ")" for rings in _polygons(g)]
    return head + (name("POLYGON") + polygons[0] if len(polygons) == 1 and not multi else name("MULTIPOLYGON") + "(" + ", ".join(polygons) + ")")


# --- binary ----------------------------------------------------------------------------------------------------

_CODES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}
_Z, _M, _SRID = 0x80000000, 0x40000000, 0x20000000


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.order = data, 0, "<"

    def take(self, form: str) -> tuple:
        try:
            out = struct.unpack_from(self.order + form, self.data, self.at)
        except struct.error:
            raise GeometryError("the bytes end too soon") from None
        self.at += struct.calcsize(self.order + form)
        return out

    def count(self) -> int:
        (n,) = self.take("I")
        if n > len(self.data):
            raise GeometryError("more elements than bytes")
        return n

    def header(self) -> tuple[int, str, int]:
        self.order = "<" if self.take("B")[0] else ">"
        (code,) = self.take("I")
        srid = self.take("i")[0] if code & _SRID else 0
        plain = code & 0x0FFFFFFF
        iso = plain // 1000
        dims = "xy" + "z" * bool(code & _Z or iso in (1, 3)) + "m" * bool(code & _M or iso in (2, 3))
        return plain % 1000, dims, srid

    def vertices(self, n: int, size: int) -> Ring:
        numbers = self.take(f"{n * size}d")
        return [list(numbers[i : i + size]) for i in range(0, n * size, size)]


def parse_wkb(data: bytes) -> dict:
    """WKB or EWKB, either byte order, ISO or extended marks for Z and M."""
    r = _Reader(data)

    def body(code: int, size: int) -> tuple[str, list[Ring]]:
        if code == 1:
            return "point", [r.vertices(1, size)]
        if code == 2:
            return "polyline", [r.vertices(r.count(), size)]
        if code == 3:
            return "polygon", [r.vertices(r.count(), size) for _ in range(r.count())]
        if code in (4, 5, 6):
            parts = []
            for _ in range(r.count()):
                inner, dims, _ = r.header()
                parts += body(inner, len(dims))[1]
            return {4: "multipoint", 5: "polyline", 6: "polygon"}[code], parts
        raise GeometryError(f"no geometry type {code}")

    code, dims, srid = r.header()
    kind, parts = body(code, len(dims))
    if kind == "polygon":
        return geometry(kind, order_rings([p for p in map(_open, parts) if len(p) >= 3]), srid, dims)
    return geometry(kind, [_part(p) for p in parts], srid, dims)


def write_wkb(g: dict, srid: bool = True, multi: bool = False) -> bytes:
    """Little-endian; EWKB with an SRID, if the geometry has one."""
    flags = (_Z if "z" in g["dims"] else 0) | (_M if "m" in g["dims"] else 0)
    with_srid = srid and g["srid"]

    def head(word: str, top: bool = True) -> bytes:
        mark = _SRID if with_srid and top else 0
        return struct.pack("<BI", 1, _CODES[word] | flags | mark) + (struct.pack("<i", g["srid"]) if mark else b"")

    vertices = lambda part: b"".join(struct.pack(f"<{len(v)}d", *v) for v in part)
    counted = lambda items: struct.pack("<I", len(items)) + b"".join(items)
    line = lambda part: struct.pack("<I", len(part)) + vertices(part)
    kind, parts = g["kind"], [p["xy"] for p in g["parts"]]
    if kind == "point":
        return head("POINT") + (vertices(parts[0]) if parts else struct.pack(f"<{len(g['dims'])}d", *[float("nan")] * len(g["dims"])))
    if kind == "multipoint":
        return head("MULTIPOINT") + counted([head("POINT", False) + vertices(p) for p in parts])
    if kind == "polyline":
        return head("LINESTRING") + line(parts[0]) if len(parts) == 1 and not multi else head("MULTILINESTRING") + counted([head("LINESTRING", False) + line(p) for p in parts])
    polygons = [counted([line(r) for r in rings]) for rings in _polygons(g)]
    return head("POLYGON") + polygons[0] if len(polygons) == 1 and not multi else head("MULTIPOLYGON") + counted([head("POLYGON", False) + p for p in polygons])


# --- JSON ---------------------------------------------------------------------------------------------------------

_JSON_KINDS = {"pt": "point", "mpt": "multipoint", "line": "polyline", "poly": "polygon"}


def write_json(g: dict) -> str:
    """{"t": kind and dimensions, "v": vertices}; a polygon's rings repeat their first vertex."""
    short = {v: k for k, v in _JSON_KINDS.items()}[g["kind"]]
    mark = {"xy": "2", "xyz": "3", "xym": "2m", "xyzm": "3m"}[g["dims"]]
    if g["kind"] == "point":
        value = g["parts"][0]["xy"][0] if g["parts"] else []
    elif g["kind"] == "multipoint":
        value = [p["xy"][0] for p in g["parts"]]
    else:
        value = [[*p["xy"], p["xy"][0]] if p["closed"] else p["xy"] for p in g["parts"]]
    return json.dumps({"t": short + mark, "v": value})


def parse_json(text: str) -> dict:
    try:
        data = json.loads(text)
        m = re.fullmatch(r"(pt|mpt|line|poly)([23])(m?)", data["t"])
        kind, dims, value = _JSON_KINDS[m[1]], "xy" + "z" * (m[2] == "3") + m[3], data["v"]
    except (ValueError, KeyError, TypeError):
        raise GeometryError("no geometry") from None
    if kind == "point":
        return geometry(kind, [_part([value])] if value else [], 0, dims)
    if kind == "multipoint":
        return geometry(kind, [_part([v]) for v in value], 0, dims)
    if kind == "polyline":
        return geometry(kind, [_part(v) for v in value], 0, dims)
    if any(len(r) < 4 or r[0] != r[-1] for r in value):
        raise GeometryError("a polygon must close")
    return geometry(kind, order_rings([_open(r) for r in value]), 0, dims)


# --- columns --------------------------------------------------------------------------------------------------------


def _safe(f: Callable):
    def g(value):
        try:
            return None if value is None else f(value)
        except GeometryError:
            return None

    return g


def _arrow_geometry() -> pa.DataType:
    part = pa.struct([("closed", pa.bool_()), ("exterior", pa.bool_()), ("xy", pa.list_(pa.list_(pa.float64())))])
    return pa.struct([("kind", pa.string()), ("srid", pa.int32()), ("dims", pa.string()), ("parts", pa.list_(part))])


def _column(f: Callable, result: T.DataType, arrow: pa.DataType):
    @F.arrow_udf(result)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([_safe(f)(v) for v in values.to_pylist()], arrow)

    return run


geom_from_wkt = _column(parse_wkt, GEOMETRY, _arrow_geometry())
geom_from_wkb = _column(parse_wkb, GEOMETRY, _arrow_geometry())
geom_from_json = _column(parse_json, GEOMETRY, _arrow_geometry())
geom_to_wkt = _column(write_wkt, T.StringType(), pa.string())
geom_to_wkb = _column(write_wkb, T.BinaryType(), pa.binary())
geom_to_json = _column(write_json, T.StringType(), pa.string())
geom_to_polygon = _column(to_polygon, GEOMETRY, _arrow_geometry())
geom_to_polyline = _column(to_polyline, GEOMETRY, _arrow_geometry())


def geom_intersects_box(geom, x1: float, y1: float, x2: float, y2: float):
    """Whether the bounding box of a geometry column overlaps a box."""
    points = F.flatten(geom["parts"]["xy"])
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return (F.array_min(xs) <= x2) & (F.array_max(xs) >= x1) & (F.array_min(ys) <= y2) & (F.array_max(ys) >= y1)


def geom_contains_point(geom, x, y):
    """Whether a point is in a polygon column, by the even-odd rule over its rings."""
    rings = F.transform(geom["parts"], lambda p: F.transform(p["xy"], lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))
    return (geom["kind"] == "polygon") & inside(x, y, rings)


def geom_area(geom):
    rings = F.transform(geom["parts"], lambda p: F.struct(p["exterior"].alias("exterior"), F.transform(p["xy"], lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))).alias("ring")))
    return F.when(geom["kind"] == "polygon", area(rings)).otherwise(0.0)


def geom_point_text(x, y):
    """WKT of a point from its coordinates, in the JVM."""
    return F.format_string("POINT(%.6f %.6f)", x, y)


def geom_length(geom):
    """Length of lines, or around rings."""

    def part(p):
        v, n = p["xy"], F.size(p["xy"])
        last = F.when(p["closed"], n).otherwise(n - 1)
        steps = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.sqrt(F.pow(v[(i + 1) % n][0] - v[i][0], 2) + F.pow(v[(i + 1) % n][1] - v[i][1], 2)))

    return F.aggregate(geom["parts"], F.lit(0.0), lambda a, p: a + part(p))


# --- predicates of two geometries ------------------------------------------------------------------------------------


def _edges(g: dict) -> list[tuple]:
    return [(a[:2], b[:2]) for p in g["parts"] for a, b in zip(p["xy"], (p["xy"][1:] + p["xy"][:1]) if p["closed"] else p["xy"][1:])]


def _side(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a, b, c) -> bool:
    return _side(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])


def _cross(e, f) -> bool:
    """Whether two segments share a point."""
    (a, b), (c, d) = e, f
    s = [_side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)]
    if s[0] * s[1] < 0 and s[2] * s[3] < 0:
        return True
    return _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b)


def _covers(g: dict, p: list[float]) -> bool:
    """Whether a point is in or on a geometry."""
    if g["kind"] == "polygon":
        return any(_on(a, b, p) for a, b in _edges(g)) or sum(contains(q["xy"], p[0], p[1]) for q in g["parts"]) % 2 == 1
    return any(_on(a, b, p) for a, b in _edges(g)) or any(v[:2] == p[:2] for q in g["parts"] for v in q["xy"])


def intersects(a: dict, b: dict) -> bool:
    """Whether two geometries share a point."""
    if any(_cross(e, f) for e in _edges(a) for f in _edges(b)):
        return True
    return any(_covers(b, v) for p in a["parts"] for v in p["xy"]) or any(_covers(a, v) for p in b["parts"] for v in p["xy"])


def covers(a: dict, b: dict) -> bool:
    """Whether no point of ``b`` is outside ``a``."""
    if not b["parts"] or not all(_covers(a, v) for p in b["parts"] for v in p["xy"]):
        return False
    for e in _edges(b):
        cuts = [0.0, 1.0]
        for f in _edges(a):
            (x0, y0), (x1, y1) = e
            (u0, v0), (u1, v1) = f
            whole = (x1 - x0) * (v1 - v0) - (y1 - y0) * (u1 - u0)
            if whole:
                cuts.append(((u0 - x0) * (v1 - v0) - (v0 - y0) * (u1 - u0)) / whole)
        cuts = sorted(c for c in cuts if 0 <= c <= 1)
        for s, t in zip(cuts, cuts[1:]):
            m = (s + t) / 2
            if t - s > 1e-12 and not _covers(a, [e[0][0] + m * (e[1][0] - e[0][0]), e[0][1] + m * (e[1][1] - e[0][1])]):
                return False
    holes = [p["xy"] for p in a["parts"] if p["closed"] and not p["exterior"]]
    return b["kind"] != "polygon" or not any(sum(contains(q["xy"], *_inner(h)) for q in b["parts"]) % 2 for h in holes)


def _inner(ring: Ring) -> tuple[float, float]:
    """A point inside a ring: between the first two crossings of a level between two of its vertices."""
    ys = sorted({v[1] for v in ring})
    y = (ys[0] + ys[1]) / 2 if len(ys) > 1 else ys[0]
    xs = sorted(a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1]) if (a[1] > y) != (b[1] > y))
    return ((xs[0] + xs[1]) / 2 if len(xs) > 1 else ring[0][0]), y


def _predicate(f: Callable):
    @F.arrow_udf(T.BooleanType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    return run


geom_intersects = _predicate(intersects)
geom_contains = _predicate(covers)
