"""Features of geographic documents: GeoJSON in and out, and the texts and codes read from their properties."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.geometry import polygonal

#: Suffixes that are read; what has none or another is taken for GeoJSON.
FORMATS = {".parquet": "parquet", ".geoparquet": "parquet", ".gml": "gml", ".kml": "kml", ".gpkg": "gpkg", ".geojson": "geojson", ".json": "geojson"}
FLOORS = "Количество этажей"


def format_of(name: str | None) -> str:
    lower = (name or "").lower()
    return next((kind for suffix, kind in FORMATS.items() if lower.endswith(suffix)), "geojson")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(ord, feature) of the features of FeatureCollections, each whole document in one row of text; feature is a variant."""
    docs = spark.read.option("wholetext", True).text(path)
    parsed = docs.select(F.try_parse_json("value").alias("doc"))
    features = F.try_variant_get("doc", "$.features", "array<variant>")
    return parsed.select(F.posexplode(features).alias("ord", "feature"))


@F.udf(ArrayType(ArrayType(ArrayType(ArrayType(DoubleType())))))
def _shape(geometry: str | None):
    shape = polygonal(json.loads(geometry)) if geometry else None
    return shape and [[[[float(v) for v in p[:2]] for p in ring] for ring in polygon] for polygon in shape]


def geometry_of(feature: Column) -> Column:
    """The polygonal part of a feature's geometry as a multipolygon; null for points, lines and nothing."""
    return _shape(F.to_json(F.try_variant_get(feature, "$.geometry", "variant")))


def property_of(feature: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(feature, f"$.properties['{name}']", kind)


def floors_of(feature: Column) -> Column:
    """The number of floors as text: of the nested properties, else of the feature's own; zero and blank count as none."""

    def good(c: Column) -> Column:
        return F.when(~F.trim(c).isin("", "0", "null"), c)

    nested = F.try_variant_get(feature, f"$.properties.properties['{FLOORS}']", "string")
    return F.coalesce(good(nested), good(property_of(feature, FLOORS)))


def object_text(feature: Column) -> Column:
    """The use text of an object: its type with its floors, its type, or that it is unknown."""
    kind = F.nullif(F.trim(F.try_variant_get(feature, "$.properties.physical_object_type.name", "string")), F.lit(""))
    floors = floors_of(feature)
    return F.when(kind.isNull(), "неизвестный объект").when(floors.isNotNull(), F.concat(kind, F.lit(", "), floors, F.lit(" этажей"))).otherwise(kind)


def zone_code(feature: Column) -> Column:
    return F.try_variant_get(feature, "$.properties.functional_zone_type.id", "string")


def zone_name(feature: Column) -> Column:
    nick, name = (F.try_variant_get(feature, p, "string") for p in ("$.properties.functional_zone_type.nickname", "$.properties.functional_zone_type.name"))
    return F.coalesce(F.nullif(nick, F.lit("")), name)


def write_geojson_lines(rows: DataFrame, geometry: str, path: str) -> None:
    """One feature per line: the multipolygon and all other columns as properties."""
    others = F.struct(*[c for c in rows.columns if c != geometry])
    shape = F.when(F.col(geometry).isNotNull(), F.struct(F.lit("MultiPolygon").alias("type"), F.col(geometry).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), others.alias("properties"), shape.alias("geometry"))
    rows.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_records(rows: DataFrame, path: str, geometry: str | None = None) -> None:
    """JSON records without the geometry."""
    (rows.drop(geometry) if geometry else rows).write.option("ignoreNullFields", "false").json(path)


def latest_output(files: DataFrame, prefix: str) -> DataFrame:
    """The file (path, modified) whose name starts with the prefix, the newest, then the last by path."""
    preferred = F.substring_index("path", "/", -1).startswith(prefix)
    return files.agg(F.max_by("path", F.struct(preferred, "modified", "path")).alias("path"))
