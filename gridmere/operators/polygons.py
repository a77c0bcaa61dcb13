"""
Points in polygons.

A polygon is an array of edges (lat1, lon1, lat2, lon2) holding all its rings, so
holes and multipolygons need nothing special. Each polygon is laid over cells whose
size follows its own extent, and a cell keeps only the edges that matter for a ray
cast east from inside it. Points look up their cell at each level, then count
crossings. The search runs over distinct positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.functions.sphere import cells_around
from gridmere.operators.tables import keep_first, not_null

COARSEST, FINEST = 3, 18  # cells of 45 degrees down to about 150 m
CELLS_ACROSS = 8


def edges_from_rings(rings: Column) -> Column:
    """array<ring<[lon, lat]>>, as in GeoJSON, to one array of edges."""

    def ring_edges(ring: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(ring)),
            lambda i: F.struct(
                F.element_at(F.element_at(ring, i), 2).alias("lat1"),
                F.element_at(F.element_at(ring, i), 1).alias("lon1"),
                F.element_at(F.element_at(ring, i % F.size(ring) + 1), 2).alias("lat2"),
                F.element_at(F.element_at(ring, i % F.size(ring) + 1), 1).alias("lon2"),
            ),
        )

    return F.flatten(F.transform(rings, ring_edges))


def edges_from_vertices(
    vertices: DataFrame, key: str, order: str, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Single-ring polygons given as one row per corner: key, edges."""
    ring = F.array_sort(F.collect_list(F.struct(order, lat, lon)))
    n = F.size("__ring")

    def edge(i: Column) -> Column:
        a, b = F.element_at("__ring", i), F.element_at("__ring", i % n + 1)
        return F.struct(
            a[lat].alias("lat1"), a[lon].alias("lon1"), b[lat].alias("lat2"), b[lon].alias("lon2")
        )

    return (
        vertices.groupBy(key)
        .agg(ring.alias("__ring"))
        .select(key, F.transform(F.sequence(F.lit(1), n), edge).alias("edges"))
    )


def shoelace(edges: Column) -> Column:
    """Area in the units of the coordinates, squared. Holes wind the other way."""
    twice = F.aggregate(
        edges, F.lit(0.0), lambda s, e: s + (e.lon1 * e.lat2 - e.lon2 * e.lat1)
    )
    return F.abs(twice) / 2


# --- projected area ---------------------------------------------------------
# GRS80 and the two-parallel conformal conic grid of EPSG:7899.

_A, _F = 6378137.0, 1 / 298.257222101
_LAT0, _LAT1, _LAT2, _LON0 = -37.0, -36.0, -38.0, 145.0
_EAST0, _NORTH0 = 2500000.0, 2500000.0


def _conic_constants():
    e = math.sqrt(2 * _F - _F * _F)

    def m(lat):
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    def t(lat):
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    l0, l1, l2 = (math.radians(v) for v in (_LAT0, _LAT1, _LAT2))
    n = (math.log(m(l1)) - math.log(m(l2))) / (math.log(t(l1)) - math.log(t(l2)))
    f = m(l1) / (n * t(l1) ** n)
    return e, n, f, _A * f * t(l0) ** n


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Degrees to (east, north) metres on the conic grid."""
    e, n, f, rho0 = _conic_constants()
    phi = F.radians(lat)
    s = F.sin(phi) * e
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho = F.signum(t) * F.pow(F.abs(t), F.lit(n)) * (_A * f)
    theta = (F.radians(lon) - math.radians(_LON0)) * n
    return _EAST0 + rho * F.sin(theta), _NORTH0 + rho0 - rho * F.cos(theta)


def projected_area(edges: Column) -> Column:
    """Square metres on the conic grid."""

    def flat(e: Column) -> Column:
        x1, y1 = project(e.lat1, e.lon1)
        x2, y2 = project(e.lat2, e.lon2)
        return F.struct(
            (y1 - _NORTH0).alias("lat1"), (x1 - _EAST0).alias("lon1"),
            (y2 - _NORTH0).alias("lat2"), (x2 - _EAST0).alias("lon2"),
        )

    return shoelace(F.transform(edges, flat))


# --- containment ------------------------------------------------------------


def inside(lat: Column, lon: Column, edges: Column) -> Column:
    """
    Strictly inside: an odd number of edges lies east of the point, and none goes through it. A
    point on an edge or a corner makes the count null, which is no containment.
    """

    def crosses(e: Column) -> Column:
        spans = (e.lat1 > lat) != (e.lat2 > lat)
        at = e.lon1 + (lat - e.lat1) / (e.lat2 - e.lat1) * (e.lon2 - e.lon1)
        in_line = (lon - e.lon1) * (e.lat2 - e.lat1) == (lat - e.lat1) * (e.lon2 - e.lon1)
        touches = (
            in_line
            & lat.between(F.least(e.lat1, e.lat2), F.greatest(e.lat1, e.lat2))
            & lon.between(F.least(e.lon1, e.lon2), F.greatest(e.lon1, e.lon2))
        )
        return (
            F.when(touches, F.lit(None).cast("int"))
            .when(spans, (lon < at).cast("int"))
            .otherwise(F.lit(0))
        )

    count = F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e))
    return F.coalesce(count % 2 == 1, F.lit(False))


def _polygon_cells(polygons: DataFrame, key: str, edges: str) -> DataFrame:
    e = F.col("__e")

    def limit(fn, a, b):
        return F.aggregate(e, F.lit(None).cast("double"), lambda s, x: fn(s, x[a], x[b]))

    boxed = polygons.select(F.col(key), F.col(edges).alias("__e")).withColumns(
        {
            "__s": limit(F.least, "lat1", "lat2"), "__n": limit(F.greatest, "lat1", "lat2"),
            "__w": limit(F.least, "lon1", "lon2"), "__o": limit(F.greatest, "lon1", "lon2"),
        }
    )
    extent = F.greatest(F.col("__n") - F.col("__s"), F.col("__o") - F.col("__w"), F.lit(1e-9))
    level = F.floor(F.log2(F.lit(360.0 * CELLS_ACROSS) / extent)).cast("int")
    level = F.greatest(F.lit(COARSEST), F.least(F.lit(FINEST), level))
    boxed = boxed.withColumn("__v", level).withColumn(
        "__size", F.lit(360.0) / cells_around(F.col("__v"))
    )

    def span(lo, hi, origin):
        return F.explode(
            F.sequence(
                F.floor((F.col(lo) + origin) / F.col("__size")),
                F.floor((F.col(hi) + origin) / F.col("__size")),
            )
        )

    cells = boxed.withColumn("__cx", span("__w", "__o", 180)).withColumn("__cy", span("__s", "__n", 90))
    south = F.col("__cy") * F.col("__size") - 90 - 1e-9
    west = F.col("__cx") * F.col("__size") - 180 - 1e-9
    north = south + F.col("__size") + 2e-9
    needed = F.filter(
        e,
        lambda x: (F.greatest(x.lat1, x.lat2) >= south)
        & (F.least(x.lat1, x.lat2) <= north)
        & (F.greatest(x.lon1, x.lon2) >= west),
    )
    return cells.select(key, "__v", "__cx", "__cy", needed.alias("__edges")).where(
        F.size("__edges") > 0
    )


def positions_in_polygons(
    points: DataFrame, polygons: DataFrame, key: str,
    lat: str = "lat", lon: str = "lon", edges: str = "edges",
) -> DataFrame:
    """Distinct positions with each polygon that contains them: lat, lon, key."""
    cells = _polygon_cells(polygons, key, edges)
    # Polygons of one kind use a few of the 16 levels; positions are entered in those alone.
    levels = cells.agg(F.array_sort(F.collect_set("__v"))).scalar()
    size = F.lit(360.0) / cells_around(F.col("__v"))
    spots = (
        points.where(not_null(lat, lon))
        .select(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
        .distinct()
        .withColumn("__v", F.explode(levels))
        .withColumn("__cx", F.floor((F.col("lon") + 180) / size))
        .withColumn("__cy", F.floor((F.col("lat") + 90) / size))
    )
    return (
        spots.join(cells, ["__v", "__cx", "__cy"], "inner")
        .where(inside(F.col("lat"), F.col("lon"), F.col("__edges")))
        .select("lat", "lon", key)
    )


def with_containing_area(
    points: DataFrame, polygons: DataFrame, key: str,
    lat: str = "lat", lon: str = "lon", edges: str = "edges", attributes: list[str] | None = None,
) -> DataFrame:
    """
    Every point with the area it lies in: null outside all of them, one row per area
    when it lies in several.
    """
    hits = positions_in_polygons(points, polygons, key, lat, lon, edges)
    if attributes:
        hits = hits.join(polygons.select(key, *attributes), key, "inner")
    hits = hits.withColumnsRenamed({"lat": "__la", "lon": "__lo"})
    on = (F.col(lat) == F.col("__la")) & (F.col(lon) == F.col("__lo"))
    return points.join(hits, on, "left").drop("__la", "__lo")


def point_counts(
    points: DataFrame, polygons: DataFrame, key: str, name: str,
    lat: str = "lat", lon: str = "lon", edges: str = "edges",
) -> DataFrame:
    """Points per area; every area appears, with 0 where there is none."""
    inside_areas = with_containing_area(points, polygons, key, lat, lon, edges)
    counts = inside_areas.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return polygons.select(key).join(counts, key, "left").fillna(0, subset=[name])


def point_counts_by(
    points: DataFrame, polygons: DataFrame, key: str, category: str, categories: list,
    name: str = "osm_{}_count", lat: str = "lat", lon: str = "lon", edges: str = "edges",
) -> DataFrame:
    """One zero-filled count column per category."""
    inside_areas = with_containing_area(points, polygons, key, lat, lon, edges)
    names = [name.format(c) for c in categories]
    counts = inside_areas.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.count(F.when(F.col(category) == c, 1)).alias(n) for c, n in zip(categories, names)]
    )
    return polygons.select(key).join(counts, key, "left").fillna(0, subset=names)


def smallest_lot(
    points: DataFrame, lots: DataFrame, key: str,
    area: Column | None = None, lat: str = "lat", lon: str = "lon", edges: str = "edges",
    tolerance: float = fixed.SAME_LOT_TOLERANCE, decimals: int = 1,
) -> DataFrame:
    """
    Every point with the area of the smallest lot around it (`land_m2`) and whether
    that lot is shared (`land_lot_shared`): a second lot within the tolerance of the
    smallest. A shared lot has no area of its own; no lot gives null in both.
    """
    unique = keep_first(lots, [key], [F.col(edges).asc_nulls_last()])
    sized = unique.withColumn("__area", projected_area(F.col(edges)) if area is None else area)
    hits = positions_in_polygons(points, unique, key, lat, lon, edges).join(
        sized.select(key, "__area"), key, "inner"
    )
    # The two smallest decide; a stack of units never has to be held whole.
    w = Window.partitionBy("lat", "lon").orderBy("__area", key)
    two = hits.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 2)
    answer = two.groupBy(F.col("lat").alias("__la"), F.col("lon").alias("__lo")).agg(
        F.min("__area").alias("__min"), F.max(F.when(F.col("__rn") == 2, F.col("__area"))).alias("__2nd")
    )
    shared = F.coalesce(F.col("__2nd") <= F.col("__min") * (1 + tolerance), F.lit(False))
    answer = answer.select(
        "__la", "__lo",
        F.when(~shared, F.round("__min", decimals)).alias("land_m2"),
        shared.cast("int").alias("land_lot_shared"),
    )
    on = (F.col(lat) == F.col("__la")) & (F.col(lon) == F.col("__lo"))
    return points.join(answer, on, "left").drop("__la", "__lo")
