"""
Distances on the sphere as column expressions.

Comparisons are made on `hav`, the haversine of the central angle, which grows
with the distance; kilometres are computed once, at the end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmere import fixed


def hav(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def hav_to_km(h: Column, radius_km: float = fixed.EARTH_RADIUS_KM) -> Column:
    return 2 * radius_km * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def km_to_hav(km: float, radius_km: float = fixed.EARTH_RADIUS_KM) -> float:
    return math.sin(min(km / radius_km, math.pi) / 2) ** 2


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return hav_to_km(hav(lat1, lon1, lat2, lon2))


def km_to_point(lat: Column, lon: Column, point: tuple[float, float]) -> Column:
    """Straight-line distance to one fixed point; no join."""
    return distance_km(lat, lon, F.lit(float(point[0])), F.lit(float(point[1])))


def unit_xyz(lat: Column, lon: Column) -> list[Column]:
    """Point on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return [
        (F.cos(la) * F.cos(lo)).alias("x"),
        (F.cos(la) * F.sin(lo)).alias("y"),
        F.sin(la).alias("z"),
    ]


def chord_to_km(chord: Column, radius_km: float = fixed.EARTH_RADIUS_KM) -> Column:
    half = F.greatest(F.lit(0.0), F.least(F.lit(1.0), chord / 2))
    return 2 * F.asin(half) * radius_km


def coordinate_key(lat: Column, lon: Column, decimals: int = fixed.COORDINATE_DECIMALS) -> Column:
    """'lat,lon' at a fixed number of decimals; null when either is missing."""
    text = F.format_string(f"%.{decimals}f,%.{decimals}f", lat, lon)
    return F.when(lat.isNotNull() & lon.isNotNull(), text)


# --- cells ------------------------------------------------------------------
# A level-n cell is 360 / 2^n degrees on each side; level 0 is the whole world.


def cell_size(level: int) -> float:
    return 360.0 / (1 << level)


def cells_around(level: Column) -> Column:
    """Number of cells around the globe at a level given per row."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))


def coarser(x: Column, levels: Column) -> Column:
    """The cell number so many levels up."""
    return F.call_function("shiftright", x, levels.cast("int"))


def cell_x(lon: Column, level: int) -> Column:
    n = 1 << level
    return F.pmod(F.floor((lon + 180) / F.lit(cell_size(level))), F.lit(n)).cast("long")


def cell_y(lat: Column, level: int) -> Column:
    return F.floor((lat + 90) / F.lit(cell_size(level))).cast("long")


@dataclass(frozen=True)
class Box:
    """
    Latitude/longitude limits in degrees and the range of cos(latitude) inside, held
    as named columns so that bounds built from them stay short expressions.
    """

    prefix: str

    def __getattr__(self, part: str) -> Column:
        return F.col(f"{self.prefix}_{part}")

    @property
    def columns(self) -> list[str]:
        return [f"{self.prefix}_{p}" for p in ("south", "north", "west", "east", "coslow", "coshigh")]


# Boxes are widened by this much so that rounding cannot put a point outside its own.
_SLACK = 1e-9


def add_box(
    df: DataFrame, prefix: str, south: Column, north: Column, west: Column, east: Column
) -> tuple[DataFrame, Box]:
    """Columns of a box from its limits."""
    b = Box(prefix)
    df = df.withColumns(
        {
            f"{prefix}_south": F.greatest(F.lit(-90.0), south - _SLACK),
            f"{prefix}_north": F.least(F.lit(90.0), north + _SLACK),
            f"{prefix}_west": west - _SLACK,
            f"{prefix}_east": east + _SLACK,
        }
    )
    ends = [F.cos(F.radians(b.south)), F.cos(F.radians(b.north))]
    over_equator = (b.south <= 0) & (b.north >= 0)
    df = df.withColumns(
        {
            f"{prefix}_coslow": F.greatest(F.lit(0.0), F.least(*ends)),
            f"{prefix}_coshigh": F.when(over_equator, F.lit(1.0)).otherwise(F.greatest(*ends)),
        }
    )
    return df, b


def add_cell_box(
    df: DataFrame, prefix: str, x: Column, y: Column, size: Column, reach: int = 0
) -> tuple[DataFrame, Box]:
    """The box of a cell, or of the block `reach` cells around it."""
    span = 2 * reach + 1
    return add_box(
        df, prefix,
        (y - reach) * size - 90, (y - reach + span) * size - 90,
        (x - reach) * size - 180, (x - reach + span) * size - 180,
    )


def _sq(c: Column) -> Column:
    return F.pow(F.sin(F.radians(c) / 2), F.lit(2.0))


def _lon_apart(a: Box, b: Box) -> Column:
    """Degrees between the middles of two boxes, the short way round."""
    return 180 - F.abs(180 - F.pmod((a.west + a.east - b.west - b.east) / 2, F.lit(360.0)))


def _half_widths(a: Box, b: Box) -> Column:
    return (a.east - a.west + b.east - b.west) / 2


def hav_low(a: Box, b: Box) -> Column:
    """No point of a is nearer to a point of b than this."""
    gap_lon = F.greatest(F.lit(0.0), _lon_apart(a, b) - _half_widths(a, b))
    gap_lat = F.greatest(F.lit(0.0), a.south - b.north, b.south - a.north)
    return _sq(gap_lat) + a.coslow * b.coslow * _sq(gap_lon)


def hav_high(a: Box, b: Box) -> Column:
    """No point of a is farther from a point of b than this."""
    span_lon = F.least(F.lit(180.0), _lon_apart(a, b) + _half_widths(a, b))
    span_lat = F.greatest(a.north - b.south, b.north - a.south)
    return F.least(F.lit(1.0), _sq(span_lat) + a.coshigh * b.coshigh * _sq(span_lon))


def explode_cells_within(
    df: DataFrame, box: Box, reach_hav: Column, level: Column, x: str, y: str
) -> DataFrame:
    """
    One row per cell, at a level given per row, that a circle of this size around any
    point of the box can touch. Near a pole that is every cell around the globe.
    """
    theta, n, edge = F.col("__theta"), F.col("__around"), F.col("__edge")
    df = df.withColumns(
        {
            "__theta": F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), reach_hav)))) + 2 * _SLACK,
            "__around": cells_around(level),
            "__edge": F.greatest(F.abs(box.south), F.abs(box.north)),
        }
    )
    sine = F.sin(F.radians(theta)) / F.greatest(F.lit(1e-12), F.cos(F.radians(edge)))
    df = df.withColumn("__sine", F.when(edge + theta >= 89.999, F.lit(1.0)).otherwise(sine))
    around = F.degrees(F.asin(F.col("__sine"))) + 2 * _SLACK
    df = df.withColumn(
        "__reach", F.when(F.col("__sine") >= 1, F.lit(360.0)).otherwise(around)
    )
    reach, size = F.col("__reach"), F.lit(360.0) / n
    df = df.withColumns(
        {
            "__x0": F.floor((box.west - reach + 180) / size),
            "__x1": F.floor((box.east + reach + 180) / size),
            "__y0": F.floor((F.greatest(F.lit(-90.0), box.south - theta) + 90) / size),
            "__y1": F.floor((F.least(F.lit(90.0), box.north + theta) + 90) / size),
        }
    )
    last = F.least(F.col("__x1"), F.col("__x0") + n - 1)
    return (
        df.withColumn("__xs", F.explode(F.sequence(F.col("__x0"), last)))
        .withColumn(y, F.explode(F.sequence(F.col("__y0"), F.col("__y1"))))
        .withColumn(x, F.pmod(F.col("__xs"), n))
        .drop(
            "__theta", "__around", "__edge", "__sine", "__reach",
            "__x0", "__x1", "__y0", "__y1", "__xs",
        )
    )
