"""Nearest points, polygons, lots, clusters and routes."""

from pyspark.sql import functions as F

from gridmere.catalog.registry import (
    GEO_LEFT, GEO_RIGHT, LOT_DUCK, LOT_SPARK, POLY_DUCK, POLY_SPARK, ROUTES, query, r6, shaped, table,
)
from gridmere.operators import clusters, nearest, polygons, routes

_HAV = """pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2)"""
_KM = "2 * 6371.0088e0 * asin(sqrt(h))"
_DIST = f"WITH l AS ({GEO_LEFT}), r AS ({GEO_RIGHT}), d AS (SELECT l.id, r.fid, r.category, {_HAV} AS h FROM l CROSS JOIN r)"


def left(spark, sf):
    return shaped(spark, sf, GEO_LEFT)


def right(spark, sf):
    return shaped(spark, sf, GEO_RIGHT)


def areas(spark, sf):
    return polygons.edges_from_vertices(shaped(spark, sf, POLY_SPARK), "area_id", "seq")


@query("nearest_point", f"{_DIST} SELECT id, round(2 * 6371.0088e0 * asin(sqrt(min(h))), 6) AS nearest_stop_km FROM d GROUP BY 1")
def nearest_point(spark, sf):
    out = nearest.with_nearest_km(left(spark, sf), right(spark, sf), "nearest_stop_km")
    return out.select("id", r6("nearest_stop_km", "nearest_stop_km"))


@query(
    "nearest_k_points",
    f"""{_DIST}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h, fid) AS rank FROM d)
  SELECT id, CAST(rank AS INT) AS rank, fid, round({_KM}, 6) AS km FROM o WHERE rank <= 3""",
)
def nearest_k_points(spark, sf):
    origins = left(spark, sf)
    near = nearest.nearest_k(origins, right(spark, sf), 3)
    return origins.join(near, ["lat", "lon"]).select("id", "rank", "fid", r6("km", "km"))


@query(
    "nearest_by_category",
    f"""{_DIST} SELECT id, {', '.join(f'round(2 * 6371.0088e0 * asin(sqrt(min(h) FILTER (category = {c}))), 6) AS nearest_{c}_km' for c in range(5))} FROM d GROUP BY 1""",
)
def nearest_by_category(spark, sf):
    out = nearest.with_nearest_km_by(left(spark, sf), right(spark, sf), "category", list(range(5)))
    return out.select("id", *[r6(f"nearest_{c}_km", f"nearest_{c}_km") for c in range(5)])


def _inside_sql(points: str, corners: str, key: str) -> str:
    """CTEs: p (points), e (edges), hit (point id, polygon key)."""
    return f"""WITH p AS ({points}), v AS ({corners}),
  e AS (SELECT {key}, lat AS a1, lon AS o1, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS a2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS o2
    FROM v WINDOW w AS (PARTITION BY {key} ORDER BY seq)),
  hit AS (SELECT p.id, e.{key} FROM p JOIN e ON (e.a1 > p.lat) <> (e.a2 > p.lat) AND p.lon < e.o1 + (p.lat - e.a1) / (e.a2 - e.a1) * (e.o2 - e.o1)
    GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


_POINTS = f"SELECT id, lat, lon FROM ({GEO_LEFT}) q"


@query(
    "point_in_polygon",
    f"{_inside_sql(_POINTS, POLY_DUCK, 'area_id')} SELECT p.id, hit.area_id FROM p LEFT JOIN hit ON p.id = hit.id",
)
def point_in_polygon(spark, sf):
    return polygons.with_containing_area(left(spark, sf), areas(spark, sf), "area_id").select("id", "area_id")


def _border(vertices):
    """Every corner of the areas and the middle of every side: points on the border."""
    return f"""SELECT area_id * 10 + seq AS id, lat, lon FROM ({vertices}) v
  UNION ALL SELECT 1000 + a.area_id * 10 + a.seq AS id, (a.lat + b.lat) / 2 AS lat, (a.lon + b.lon) / 2 AS lon
  FROM ({vertices}) a JOIN ({vertices}) b ON a.area_id = b.area_id AND b.seq = (a.seq + 1) % 6"""


@query(
    "border_points_outside",
    f"SELECT id, CAST(NULL AS INTEGER) AS area_id FROM ({_border(POLY_DUCK)}) p",
)
def border_points_outside(spark, sf):
    border = shaped(spark, sf, _border(POLY_SPARK))
    return polygons.with_containing_area(border, areas(spark, sf), "area_id").select("id", "area_id")


_STOPS = f"SELECT fid AS id, category, lat, lon FROM ({GEO_RIGHT}) q"


@query(
    "area_point_counts",
    f"{_inside_sql(_STOPS, POLY_DUCK, 'area_id')} SELECT n_nationkey AS area_id, coalesce(c, 0) AS stop_count FROM nation LEFT JOIN (SELECT area_id, count(*) AS c FROM hit GROUP BY 1) q ON n_nationkey = area_id",
)
def area_point_counts(spark, sf):
    return polygons.point_counts(right(spark, sf), areas(spark, sf), "area_id", "stop_count")


@query(
    "area_category_counts",
    f"""{_inside_sql(_STOPS, POLY_DUCK, 'area_id')}, c AS (SELECT hit.area_id, category FROM hit JOIN p ON p.id = hit.id)
  SELECT n_nationkey AS area_id, {', '.join(f'count(CASE WHEN category = {c} THEN 1 END) AS osm_{c}_count' for c in range(5))}
  FROM nation LEFT JOIN c ON n_nationkey = area_id GROUP BY 1""",
)
def area_category_counts(spark, sf):
    return polygons.point_counts_by(right(spark, sf), areas(spark, sf), "area_id", "category", list(range(5)))


@query(
    "point_access",
    f"""{_inside_sql(_STOPS, POLY_DUCK, 'area_id')}, l AS ({GEO_LEFT}), r AS ({GEO_RIGHT}), d AS (SELECT l.id, min({_HAV}) AS h FROM l CROSS JOIN r GROUP BY 1),
  pl AS (SELECT l.id, e.area_id FROM l JOIN e ON (e.a1 > l.lat) <> (e.a2 > l.lat) AND l.lon < e.o1 + (l.lat - e.a1) / (e.a2 - e.a1) * (e.o2 - e.o1) GROUP BY 1, 2 HAVING count(*) % 2 = 1),
  n AS (SELECT area_id, count(*) AS c FROM hit GROUP BY 1)
  SELECT l.id, pl.area_id, round({_KM}, 6) AS nearest_stop_km, CASE WHEN pl.area_id IS NOT NULL THEN coalesce(n.c, 0) END AS stop_count
  FROM l JOIN d ON l.id = d.id LEFT JOIN pl ON l.id = pl.id LEFT JOIN n ON pl.area_id = n.area_id""",
)
def point_access(spark, sf):
    stops, shapes = right(spark, sf), areas(spark, sf)
    located = polygons.with_containing_area(left(spark, sf), shapes, "area_id")
    counts = polygons.point_counts(stops, shapes, "area_id", "stop_count")
    out = nearest.with_nearest_km(located, stops, "nearest_stop_km").join(counts, "area_id", "left")
    return out.select("id", "area_id", r6("nearest_stop_km", "nearest_stop_km"), "stop_count")


@query(
    "same_name_pairs",
    f"""WITH r AS ({GEO_RIGHT}), d AS (SELECT l.name, l.fid AS a, r.fid AS b, {_HAV} AS h FROM r l JOIN r ON l.name = r.name AND l.fid < r.fid)
  SELECT name, a, b, round({_KM}, 6) AS km FROM d WHERE {_KM} <= 30""",
)
def same_name_pairs(spark, sf):
    return clusters.pairs_within(right(spark, sf), "fid", "name", 30.0).select("name", "a", "b", r6("km", "km"))


@query(
    "merged_stops",
    f"""WITH RECURSIVE r AS ({GEO_RIGHT}), d AS (SELECT l.fid AS a, r.fid AS b, {_HAV} AS h FROM r l JOIN r ON l.name = r.name),
  e AS (SELECT a, b FROM d WHERE {_KM} <= 30), reach(a, b) AS (SELECT fid, fid FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
  g AS (SELECT a, min(b) AS root FROM reach GROUP BY 1)
  SELECT name, count(*) AS records, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon FROM r JOIN g ON r.fid = g.a GROUP BY root, name""",
)
def merged_stops(spark, sf):
    out = clusters.merge_same_name(right(spark, sf), "fid", "name", 30.0)
    return out.select("name", "records", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@query(
    "smallest_lot",
    f"""{_inside_sql(_POINTS, LOT_DUCK, 'lot_id')}, s AS (SELECT lot_id, abs(sum(o1 * a2 - o2 * a1)) / 2 AS area FROM e GROUP BY 1),
  h AS (SELECT id, area, row_number() OVER (PARTITION BY id ORDER BY area, lot_id) AS rn FROM hit JOIN s USING (lot_id)),
  t AS (SELECT id, min(area) AS m, max(CASE WHEN rn = 2 THEN area END) AS m2 FROM h WHERE rn <= 2 GROUP BY 1)
  SELECT p.id, CASE WHEN NOT coalesce(m2 <= m * 1.01e0, false) THEN round(m, 6) END AS land_m2, CASE WHEN m IS NOT NULL THEN CAST(coalesce(m2 <= m * 1.01e0, false) AS INT) END AS land_lot_shared
  FROM p LEFT JOIN t ON p.id = t.id""",
)
def smallest_lot(spark, sf):
    lots = polygons.edges_from_vertices(shaped(spark, sf, LOT_SPARK), "lot_id", "seq")
    out = polygons.smallest_lot(
        left(spark, sf), lots, "lot_id", area=polygons.shoelace(F.col("edges")), decimals=6
    )
    return out.select("id", "land_m2", "land_lot_shared")


def _projected_sql() -> str:
    e, n, f, rho0 = polygons._conic_constants()
    af = 6378137.0 * f
    t = f"(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {e!r} * sin(radians(lat))) / (1 + {e!r} * sin(radians(lat))), {e / 2!r}))"
    return f"""WITH v AS ({LOT_DUCK}), q AS (SELECT lot_id, seq, pow({t}, {n!r}) * {af!r} AS rho, (radians(lon) - radians(145)) * {n!r} AS th FROM v),
  xy AS (SELECT lot_id, seq, rho * sin(th) AS x, {rho0!r} - rho * cos(th) AS y FROM q),
  e AS (SELECT lot_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM xy WINDOW w AS (PARTITION BY lot_id ORDER BY seq))
  SELECT lot_id, round(abs(sum(y * x2 - y2 * x)) / 2 / 1000000, 4) AS sqkm FROM e GROUP BY 1"""


@query("projected_area", _projected_sql())
def projected_area(spark, sf):
    lots = polygons.edges_from_vertices(shaped(spark, sf, LOT_SPARK), "lot_id", "seq")
    return lots.select("lot_id", F.round(polygons.projected_area(F.col("edges")) / 1000000, 4).alias("sqkm"))


@query(
    "best_routes",
    f"""WITH r AS ({ROUTES}), c AS (SELECT DISTINCT o_custkey AS origin, l_suppkey AS dest FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION SELECT c_custkey, 1 + c_custkey % 100 FROM customer)
  SELECT c.origin, min(drive_km) AS nearest_train_station_drive_km, min(drive_min) AS nearest_train_station_drive_min FROM c LEFT JOIN r ON c.origin = r.origin AND c.dest = r.dest GROUP BY 1""",
)
def best_routes(spark, sf):
    bought = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("origin"), F.col("l_suppkey").alias("dest")
    )
    k = F.col("c_custkey")
    other = table(spark, sf, "customer").select(k.alias("origin"), (k % 100 + 1).alias("dest"))
    return routes.best_routes(
        bought.unionByName(other).distinct(), shaped(spark, sf, ROUTES), "origin", "dest"
    )


@query(
    "route_origins",
    f"""SELECT printf('%.5f,%.5f', lat, lon) AS origin_key, round(min(lat), 5) AS lat, round(min(lon), 5) AS lon FROM ({GEO_LEFT}) t GROUP BY 1""",
)
def route_origins(spark, sf):
    return routes.origins(left(spark, sf))


@query(
    "routes_to_centre",
    f"""SELECT c_custkey AS origin, drive_km AS cbd_drive_km, drive_min AS cbd_drive_min FROM customer LEFT JOIN (SELECT * FROM ({ROUTES}) q WHERE dest = 7) r ON c_custkey = origin""",
)
def routes_to_centre(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("origin"))
    return routes.routes_to(keys, shaped(spark, sf, ROUTES), 7, origin="origin", dest="dest")


