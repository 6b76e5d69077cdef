"""Layers of geometries from GeoParquet, KML and GML, as (properties.., geometry) in degrees."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.geometry import from_utm, from_web_mercator
from .features import format_of, geometry_of
from .geojson import read_features
from .gpkg import BOX, read_gpkg

_SHAPE = ArrayType(ArrayType(ArrayType(ArrayType(DoubleType()))))


def decode_wkb(data: bytes | None) -> list | None:
    """The polygonal part of well-known binary as a multipolygon; a point is a polygon of one ring of one point."""
    if not data:
        return None
    at = 0

    def number(kind: str, order: str):
        nonlocal at
        value = struct.unpack_from(order + kind, data, at)[0]
        at += struct.calcsize(kind)
        return value

    def geometry() -> list:
        nonlocal at
        order = "<" if data[at] == 1 else ">"
        at += 1
        code = number("I", order)
        kind, extra = code % 1000 & 0xFF, sum(bool(x) for x in (code & 0x80000000 or 1000 <= code % 10000 < 2000, code & 0x40000000 or 2000 <= code % 10000 < 3000))

        def points(n: int) -> list[list[float]]:
            nonlocal at
            values = np.frombuffer(data, order + "f8", n * (2 + extra), at).reshape(n, 2 + extra)
            at += values.nbytes
            return values[:, :2].tolist()

        def point() -> list[float]:
            return points(1)[0]

        def ring() -> list:
            return points(number("I", order))

        if kind == 1:
            return [[[point()]]]
        if kind == 2:
            ring()
            return []
        if kind == 3:
            return [[ring() for _ in range(number("I", order))]]
        return [p for _ in range(number("I", order)) for p in geometry()]

    return geometry() or None


@F.pandas_udf(_SHAPE)
def from_wkb(data: pd.Series) -> pd.Series:
    return data.map(decode_wkb)


def _coordinates(text: Column, pair: str, part: str) -> Column:
    """Rings written as text: pairs or triples of numbers, cut by `pair` and inside by `part`."""
    points = F.filter(F.split(F.trim(text), pair), lambda p: p != "")
    return F.transform(points, lambda p: F.transform(F.slice(F.split(p, part), 1, 2), lambda v: v.cast("double")))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, geometry) of the polygons and points of a KML file's placemarks."""
    ring = "struct<LinearRing:struct<coordinates:string>>"
    schema = f"name string, Polygon struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>, Point struct<coordinates:string>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    outer = F.array(_coordinates(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+", ","))
    inner = F.transform(F.coalesce("Polygon.innerBoundaryIs", F.array().cast(f"array<{ring}>")), lambda r: _coordinates(r["LinearRing"]["coordinates"], r"\s+", ","))
    point = F.array(F.array(_coordinates(F.col("Point.coordinates"), r"\s+", ",")))
    return rows.select("name", F.when(F.col("Polygon").isNotNull(), F.array(F.concat(outer, inner))).when(F.col("Point").isNotNull(), point).alias("geometry"))


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    return spark.read.parquet(path).withColumn(geometry, from_wkb(geometry))


def to_degrees(geometry: Column, crs: str) -> Column:
    """Geometry in degrees from a known system of coordinates; others are refused."""
    if crs == "EPSG:4326":
        return geometry
    utm = re.fullmatch(r"EPSG:32([67])(0[1-9]|[1-5]\d|60)", crs)
    if crs != "EPSG:3857" and not utm:
        raise ValueError(f"{crs} isn't known; give EPSG:4326, EPSG:3857 or a UTM zone's")

    def point(p: Column) -> Column:
        return F.array(*(from_utm(p[0], p[1], int(utm[2]), utm[1] == "7") if utm else from_web_mercator(p[0], p[1])))

    return F.transform(geometry, lambda g: F.transform(g, lambda r: F.transform(r, point)))


def _positions(text: Column) -> Column:
    """Positions of two numbers each, written one after the other."""
    numbers = F.filter(F.split(F.trim(text), r"[\s,]+"), lambda v: v != "")
    return F.transform(F.sequence(F.lit(0), (F.size(numbers) / 2).cast("int") - 1), lambda k: F.transform(F.slice(numbers, 2 * k + 1, 2), lambda v: v.cast("double")))


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(name, geometry) of the members of a GML file with points and polygons of two dimensions, and the system of coordinates that the first geometry names.

    Members are those of featureMember elements, whatever their prefixes. Positions are taken as easting or longitude first, as writers of such files put them for
    systems given as EPSG:n; those given as urn:ogc:def:crs:EPSG::4326 have latitude first, and are turned.
    """
    text = spark.read.option("wholetext", False).option("lineSep", "featureMember>").text(path).select("value")
    member = text.where(F.col("value").rlike(r"<(?:\w+:)?(?:Point|Polygon)[\s>]"))

    def inside(tag: str, all_of: bool = False) -> Column:
        form = rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"
        return F.regexp_extract_all("value", F.lit(form), F.lit(1)) if all_of else F.regexp_extract("value", form, 1)

    crs = F.regexp_extract("value", r'srsName="([^"]*)"', 1)
    rings = F.transform(F.concat(inside("exterior", True), inside("interior", True)), lambda x: F.regexp_extract(x, r"(?s)<(?:\w+:)?(?:posList|coordinates)[^>]*>(.*?)<", 1))
    polygon = F.when(inside("exterior") != "", F.array(F.transform(rings, _positions)))
    spot = F.coalesce(F.nullif(inside("pos"), F.lit("")), F.nullif(inside("coordinates"), F.lit("")))
    point = F.when(spot.isNotNull(), F.array(F.array(_positions(spot))))
    name = F.nullif(inside("name"), F.lit(""))
    rows = member.select(name.alias("name"), F.coalesce(polygon, point).alias("geometry"), crs.alias("crs"))
    named = rows.where("crs <> ''").select("crs").first()
    given = named["crs"] if named else "EPSG:4326"
    code = re.search(r"(\d+)/?$", given)
    turned = given.startswith("urn:") and code and code[1] == "4326"
    flip = F.transform("geometry", lambda g: F.transform(g, lambda r: F.transform(r, lambda p: F.reverse(p))))
    return rows.select("name", (flip if turned else F.col("geometry")).alias("geometry")), f"EPSG:{code[1]}" if code else given


def read_layer(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """A layer of any known format by its suffix, in degrees; files that name their system of coordinates are taken at their word."""
    kind = format_of(path)
    if kind == "parquet":
        rows = read_geoparquet(spark, path)
    elif kind == "kml":
        rows = read_kml(spark, path)
    elif kind == "geojson":
        rows = read_features(spark, path).withColumn("geometry", geometry_of(F.col("feature"))).drop("path")
    elif kind == "gml":
        rows, crs = read_gml(spark, path)
    else:
        rows, crs = read_gpkg(spark, path)
        rows = rows.withColumn("geometry", from_wkb("wkb")).drop("wkb", *BOX)
    return rows.withColumn("geometry", to_degrees(F.col("geometry"), crs))


def require_polygons(rows: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Rows whose geometry has a ring of three points or more."""
    return rows.where(F.exists(F.coalesce(geometry, F.array().cast(_SHAPE)), lambda g: F.size(g[0]) >= 3))
