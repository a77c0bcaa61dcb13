"""Driving distances from a landed route table (origin, destination, km, minutes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def origins(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct rounded positions with their text key."""
    from gridmere import fixed
    from gridmere.functions.sphere import coordinate_key
    from gridmere.operators.tables import not_null

    d = fixed.COORDINATE_DECIMALS
    return (
        df.where(not_null(lat, lon))
        .groupBy(coordinate_key(F.col(lat), F.col(lon)).alias("origin_key"))
        .agg(F.min(F.round(lat, d)).alias(lat), F.min(F.round(lon, d)).alias(lon))
    )


def best_routes(
    candidates: DataFrame,
    routes: DataFrame,
    origin: str = "origin_key",
    dest: str = "dest_key",
    km: str = "drive_km",
    minutes: str = "drive_min",
    prefix: str = "nearest_train_station",
) -> DataFrame:
    """
    Per origin, the least distance and the least time over its candidates. The two
    minima are independent, so they may belong to different destinations; candidates
    without a route do not count.
    """
    return (
        candidates.join(routes.select(origin, dest, km, minutes), [origin, dest], "left")
        .groupBy(origin)
        .agg(F.min(km).alias(f"{prefix}_{km}"), F.min(minutes).alias(f"{prefix}_{minutes}"))
    )


def routes_to(
    from_keys: DataFrame, routes: DataFrame, dest_key: str, prefix: str = "cbd",
    origin: str = "origin_key", dest: str = "dest_key",
    km: str = "drive_km", minutes: str = "drive_min",
) -> DataFrame:
    """The route of every origin to one destination, null where there is none."""
    one = routes.where(F.col(dest) == dest_key).select(
        origin, F.col(km).alias(f"{prefix}_{km}"), F.col(minutes).alias(f"{prefix}_{minutes}")
    )
    return from_keys.join(one, origin, "left")
