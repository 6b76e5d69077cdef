"""Planar geometry on nested arrays: a multipolygon is an array of polygons, a polygon of rings, a ring of (x, y)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .clipping import SHAPES, overlap_areas

Ring = list[tuple[float, float]]
#: Spark's type of a multipolygon.
MULTIPOLYGON = "array<array<array<array<double>>>>"

# The WGS 84 ellipsoid and the UTM projection.
_A, _F, _K0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_E2 = _F * (2 - _F)


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Area of the overlap of two boxes [x0, y0, x1, y1]; 0 where they only touch."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring by the shoelace formula, positive counter-clockwise."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, following, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def area(geometry: Column) -> Column:
    """Area of a multipolygon: outer rings less their holes, whatever way rings turn."""

    def polygon(rings: Column) -> Column:
        areas = F.transform(rings, lambda r: F.abs(ring_area(r)))
        return areas[0] * 2 - F.aggregate(areas, F.lit(0.0), lambda s, t: s + t)

    return F.aggregate(F.transform(geometry, polygon), F.lit(0.0), lambda s, t: s + t)


def utm_zone(longitude: Column) -> Column:
    return F.least(F.floor((longitude + 180) / 6) + 1, F.lit(60)).cast("int")


def to_utm(longitude: Column, latitude: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (series of the transverse Mercator projection, north of the equator) in metres."""
    ep2 = _E2 / (1 - _E2)
    phi, lam = F.radians(latitude), F.radians(longitude) - F.radians(zone * 6 - 183)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(_A) / F.sqrt(1 - _E2 * sin * sin)
    t, c, a = tan * tan, ep2 * cos * cos, lam * cos
    e4, e6 = _E2**2, _E2**3
    m = _A * (
        (1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )
    x = _K0 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a**5 / 120) + _E0
    y = _K0 * (m + n * tan * (a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a**6 / 720))
    return x, y


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of easting and northing in a UTM zone, the series of the inverse projection."""
    ep2, e1 = _E2 / (1 - _E2), (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    north = y - 10_000_000.0 if south else y
    mu = north / (_K0 * _A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    phi = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    c, t = ep2 * cos * cos, tan * tan
    n, r = _A / F.sqrt(1 - _E2 * sin * sin), _A * (1 - _E2) / F.pow(1 - _E2 * sin * sin, F.lit(1.5))
    d = (x - _E0) / (n * _K0)
    lat = phi - (n * tan / r) * (
        d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d**6 / 720
    )
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d**5 / 120) / cos
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of EPSG:3857 metres."""
    return F.degrees(x / _A), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2)


def clean_ring(ring: list) -> Ring:
    """Points without repetitions and without the closing one."""
    out: Ring = []
    for p in ring:
        q = (float(p[0]), float(p[1]))
        if not out or out[-1] != q:
            out.append(q)
    if len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def _signed(ring: Ring) -> float:
    p = np.array(ring)
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def overlap_area(one: list, two: list) -> float:
    """Area of the intersection of two multipolygons with holes."""
    return float(overlap_areas(pa.array([one], SHAPES), pa.array([two], SHAPES))[0])


def contains(geometry: list, x: float, y: float) -> bool:
    """Whether the point lies strictly inside: even crossings count as outside, and so does the boundary."""
    inside = False
    for polygon in () if geometry is None else geometry:
        for raw in polygon:
            ring = clean_ring(raw)
            for i, (bx, by) in enumerate(ring):
                ax, ay = ring[i - 1]
                cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                    return False
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    inside = not inside
    return inside


def inside_point(geometry: list) -> tuple[float, float] | None:
    """A point inside: the middle of the widest stretch of the horizontal line between two levels near the middle of the height."""
    best: tuple[float, float, float] | None = None
    for polygon in () if geometry is None else geometry:
        rings = [r for r in map(clean_ring, polygon) if len(r) > 2]
        if not rings:
            continue
        levels = sorted({y for r in rings for _, y in r})
        middle = (levels[0] + levels[-1]) / 2
        above = min((v for v in levels if v > middle), default=None)
        below = max((v for v in levels if v <= middle), default=None)
        if above is None or below is None:
            continue
        y, cuts = (above + below) / 2, []
        for r in rings:
            for i, (bx, by) in enumerate(r):
                ax, ay = r[i - 1]
                if (ay > y) != (by > y):
                    cuts.append(ax + (y - ay) / (by - ay) * (bx - ax))
        cuts.sort()
        for a, b in zip(cuts[::2], cuts[1::2], strict=False):
            if best is None or b - a > best[0]:
                best = (b - a, (a + b) / 2, y)
    return None if best is None else best[1:]


def polygonal(geometry: dict | None) -> list | None:
    """The polygonal part of a GeoJSON geometry as a multipolygon; None if there is none."""
    if not geometry:
        return None
    kind = geometry.get("type")
    if kind == "Polygon":
        return [geometry["coordinates"]]
    if kind == "MultiPolygon":
        return list(geometry["coordinates"])
    if kind == "GeometryCollection":
        parts = [p for g in geometry.get("geometries") or [] for p in polygonal(g) or []]
        return parts or None
    return None
