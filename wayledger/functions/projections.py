"""Coordinate systems by number or text, and positions taken from one to another with built-in functions.

The systems follow from rules: WGS 84 in degrees (4326), Web Mercator (3857), the zones of Universal Transverse Mercator (32601
to 32660 north, 32701 to 32760 south), and the South African Lo belts (2046 to 2055). Others with the same two projections
can be registered from their text and get negative numbers.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayledger.functions.geometry import EARTH_RADIUS, from_mercator, mercator, point


@dataclass(frozen=True)
class Crs:
    """A coordinate system on the WGS 84 ellipsoid: degrees, Web Mercator or transverse Mercator."""

    kind: str  # 'degrees', 'mercator' or 'transverse'
    meridian: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    westward: bool = False  # axes run west and south

    def text(self) -> str:
        """The system as a list of +parameters."""
        if self.kind == "degrees":
            return "+proj=longlat +datum=WGS84 +no_defs"
        if self.kind == "mercator":
            return f"+proj=merc +a={EARTH_RADIUS:.0f} +b={EARTH_RADIUS:.0f} +lon_0=0 +units=m +no_defs"
        axis = " +axis=wsu" if self.westward else ""
        return f"+proj=tmerc +lat_0=0 +lon_0={self.meridian:g} +k={self.scale:g} +x_0={self.east:g} +y_0={self.north:g}{axis} +datum=WGS84 +units=m +no_defs"


_registered: dict[int, Crs] = {}


def crs_of(srid: int) -> Crs:
    """The system of a number; fails if it is unknown."""
    if srid in _registered:
        return _registered[srid]
    if srid == 4326:
        return Crs("degrees")
    if srid in (3857, 900913):
        return Crs("mercator")
    zone = srid % 100
    if srid // 100 in (326, 327) and 1 <= zone <= 60:
        return Crs("transverse", 6.0 * zone - 183, 0.9996, 500_000.0, 10_000_000.0 if srid // 100 == 327 else 0.0)
    if 2046 <= srid <= 2055:
        return Crs("transverse", 15.0 + 2 * (srid - 2046), westward=True)
    raise ValueError(f"no coordinate system {srid}")


def parse_crs(text: str) -> Crs:
    """A system from +parameters or from well-known text."""
    if "+proj" in text:
        p = dict(re.findall(r"\+(\w+)=(\S+)", text))
        if p["proj"] in ("longlat", "latlong"):
            return Crs("degrees")
        if p["proj"] == "merc":
            return Crs("mercator")
        if p["proj"] == "utm":
            return crs_of((32700 if "+south" in text else 32600) + int(p["zone"]))
        if p["proj"] == "tmerc":
            return Crs("transverse", *(float(p.get(k, d)) for k, d in (("lon_0", 0), ("k", 1), ("x_0", 0), ("y_0", 0))), p.get("axis") == "wsu")
        raise ValueError(f"no projection {p['proj']!r}")
    p = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["([^"]+)"\s*,\s*([-+0-9.eE]+)\]', text)}
    name = re.search(r'PROJECTION\["([^"]+)"', text)
    if not name:
        if "GEOGCS" in text or "GEOGCRS" in text:
            return Crs("degrees")
        raise ValueError(f"no coordinate system: {text[:40]!r}")
    if "transverse" in name.group(1).lower():
        return Crs("transverse", p.get("central_meridian", 0.0), p.get("scale_factor", 1.0), p.get("false_easting", 0.0), p.get("false_northing", 0.0), bool(re.search(r"AXIS\[[^]]*WEST", text)))
    if "mercator" in name.group(1).lower():
        return Crs("mercator")
    raise ValueError(f"no projection {name.group(1)!r}")


def srid_of_text(text: str) -> int:
    """The number of a system given as text; a system without one is registered under a negative number."""
    wanted = parse_crs(text)
    known = [4326, 3857, *range(32601, 32661), *range(32701, 32761), *range(2046, 2056), *_registered]
    for srid in known:
        if crs_of(srid) == wanted:
            return srid
    srid = min([0, *_registered]) - 1
    _registered[srid] = wanted
    return srid


_FLATTENING = 1 / 298.257223563
_N = _FLATTENING / (2 - _FLATTENING)
_E = 2 * math.sqrt(_N) / (1 + _N)
_A = EARTH_RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the fourth order: forward, back, and from the conformal latitude
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _series(terms, f) -> Column:
    return sum((F.lit(c) * f(2 * j) for j, c in enumerate(terms, 1)), F.lit(0.0))


def project(crs: Crs, lon: Column, lat: Column) -> Column:
    """struct<x, y> in the system, of degrees."""
    if crs.kind == "degrees":
        return point(lon, lat)
    if crs.kind == "mercator":
        return mercator(lon, lat)
    s, d = F.sin(F.radians(lat)), F.radians(lon - crs.meridian)
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = F.lit(crs.scale * _A) * (eta + _series(_ALPHA, lambda k: F.cos(k * xi) * F.sinh(k * eta)))
    north = F.lit(crs.scale * _A) * (xi + _series(_ALPHA, lambda k: F.sin(k * xi) * F.cosh(k * eta)))
    x, y = east + crs.east, north + crs.north
    return point(-x, -y) if crs.westward else point(x, y)


def unproject(crs: Crs, x: Column, y: Column) -> Column:
    """struct<lon, lat> in degrees, of a place in the system."""
    if crs.kind == "degrees":
        return F.struct(x.alias("lon"), y.alias("lat"))
    if crs.kind == "mercator":
        return from_mercator(x, y)
    if crs.westward:
        x, y = -x, -y
    xi, eta = (y - crs.north) / (crs.scale * _A), (x - crs.east) / (crs.scale * _A)
    xi0 = xi - _series(_BETA, lambda k: F.sin(k * xi) * F.cosh(k * eta))
    eta0 = eta - _series(_BETA, lambda k: F.cos(k * xi) * F.sinh(k * eta))
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi + _series(_DELTA, lambda k: F.sin(k * chi))
    return F.struct((F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + crs.meridian).alias("lon"), F.degrees(lat).alias("lat"))


def reproject(x: Column, y: Column, source: int, target: int) -> Column:
    """struct<x, y> in the system ``target`` of a place in ``source``."""
    if source == target:
        return point(x, y)
    place = unproject(crs_of(source), x, y)
    return project(crs_of(target), place["lon"], place["lat"])
