"""Landed JSON: point and polygon features, attribute pages, amenity elements, embedded series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.functions.text import code_key
from gridmere.functions.numbers import to_number
from gridmere.operators.polygons import edges_from_rings
from gridmere.operators.tables import not_null

# Coordinates are read as raw text, since their nesting depends on the geometry type.
_FEATURES = (
    "features array<struct<properties: map<string, string>, attributes: map<string, string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """
    One row per feature of one file, or of every page in a folder. With `lines`, each
    line is a collection of its own, so that a large file can be split.
    """
    pages = spark.read.schema(_FEATURES).option("multiLine", not lines).json(path)
    return pages.select(F.explode("features").alias("f")).select("f.*")


def _prop(name: str) -> Column:
    """A property under its upper-case name, else its lower-case one."""
    return F.coalesce(
        F.try_element_at("properties", F.lit(name.upper())),
        F.try_element_at("properties", F.lit(name.lower())),
    )


def read_stops(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Point features only, with both coordinates."""
    xy = F.from_json("geometry.coordinates", "array<double>")
    return (
        read_features(spark, path, lines)
        .where((F.col("geometry.type") == "Point") & (F.size(xy) >= 2))
        .select(
            _prop("stop_id").alias("stop_id"),
            _prop("stop_name").alias("stop_name"),
            F.trim(F.upper(F.coalesce(_prop("mode"), F.lit("")))).alias("stop_mode"),
            to_number(F.get(xy, F.lit(1))).alias("stop_lat"),
            to_number(F.get(xy, F.lit(0))).alias("stop_lon"),
        )
        .where(not_null("stop_lat", "stop_lon"))
    )


def read_attribute_pages(
    spark: SparkSession, path: str, fields: Sequence[str], lines: bool = False
) -> DataFrame:
    """The named attributes (or properties) of every feature on every page, as text."""
    source = F.coalesce("attributes", "properties")
    return read_features(spark, path, lines).select(
        *[F.try_element_at(source, F.lit(f)).alias(f) for f in fields]
    )


def read_area_polygons(
    spark: SparkSession, path: str, code: str = "sa2_code_2021",
    fields: Mapping[str, str] | None = None, state: tuple[str, str] | None = ("state_code_2021", "2"),
    lines: bool = False,
) -> DataFrame:
    """Areas of one state: code, the asked fields, and the edges of all their rings."""
    f = read_features(spark, path, lines)
    if state:
        f = f.where(F.try_element_at("properties", F.lit(state[0])) == state[1])
    one = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    kind = F.col("geometry.type")
    edges = F.when(kind == "Polygon", edges_from_rings(one)).when(
        kind == "MultiPolygon", edges_from_rings(F.flatten(many))
    )
    none = F.array().cast("array<struct<lat1:double,lon1:double,lat2:double,lon2:double>>")
    return f.select(
        code_key(F.try_element_at("properties", F.lit(code))).alias(code),
        *[F.try_element_at("properties", F.lit(n)).cast(t).alias(n) for n, t in (fields or {}).items()],
        F.coalesce(edges, none).alias("edges"),
    )


def read_amenities(
    spark: SparkSession, path: str, label: str = r"osm_([^/]+)\.json", lines: bool = False
) -> DataFrame:
    """Elements of one file (or folder) per category; the category is in the path."""
    schema = "lat double, lon double, center struct<lat: double, lon: double>"
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), label, 1).alias("amenity_type"),
        F.coalesce("lat", "center.lat").alias("amenity_lat"),
        F.coalesce("lon", "center.lon").alias("amenity_lon"),
    ).where(not_null("amenity_lat", "amenity_lon"))


def embedded_series(
    pages: DataFrame, key: str, html: str, fields: Sequence[str],
    pattern: str = fixed.EMBEDDED_SERIES,
) -> DataFrame:
    """
    The first dated series embedded in each page, one row per element. Pages without
    one give no rows.
    """
    schema = "array<struct<date: string, " + ", ".join(f"{f}: double" for f in fields) + ">>"
    text = F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    return (
        pages.select(key, F.explode(F.from_json(text, schema)).alias("e"))
        .select(key, F.col("e.date").try_cast("date").alias("date"), *[F.col(f"e.{f}").alias(f) for f in fields])
    )
