"""
Sources and sinks (S1-S15). Inputs are written from the given tables into the shared
folder, one new path per run, and read back by the source under test.
"""

from pyspark.sql import functions as F

from gridmere.catalog.expressions import flags_sql
from gridmere.catalog.registry import (
    GEO_RIGHT, LISTING_TEXT, PAGES_SERIES, POLY_DUCK, POLY_SPARK, WEEKLY_INDEX, YEARLY, query, r6,
    shaped, table,
)
from gridmere.operators.polygons import shoelace
from gridmere.operators.tables import with_padded_change
from gridmere.session import materialise, new_path
from gridmere.sources import geojson as J
from gridmere.sources import tables as T


def landed(df, spark, name, fmt="csv", **how):
    path = new_path(spark, name)
    T.write_table(df, path, fmt, **how)
    return path


@query(
    "listing_csv_scan",
    f"""SELECT listing_id, suburb, TRY_CAST(postcode AS BIGINT) AS postcode, TRY_CAST(weekly_rent AS DOUBLE) AS weekly_rent,
  TRY_CAST(date_listed AS DATE) AS date_listed, TRY_CAST(bedrooms AS DOUBLE) AS bedrooms, property_type,
  {flags_sql('structured_features')} FROM ({LISTING_TEXT}) t""",
)
def listing_csv_scan(spark, sf):
    return T.read_listings(spark, landed(shaped(spark, sf, LISTING_TEXT), spark, "listings"))


@query(
    "master_csv_scan",
    f"""SELECT listing_id, suburb, postcode, TRY_CAST(weekly_rent AS DOUBLE) AS weekly_rent,
  TRY_CAST(date_listed AS DATE) AS date_listed, TRY_CAST(bedrooms AS DOUBLE) AS bedrooms, property_type,
  structured_features, scraper_note FROM ({LISTING_TEXT}) t""",
)
def master_csv_scan(spark, sf):
    return T.read_master(spark, landed(shaped(spark, sf, LISTING_TEXT), spark, "master"))


_INDEX_TEXT = f"""SELECT CASE WHEN k % 9 = 0 THEN 'x' ELSE CAST(k AS STRING) END AS postcode, CAST(week AS STRING) AS date,
  CAST(v AS STRING) AS combined, CASE WHEN k % 4 = 0 THEN '0' ELSE 'np' END AS units_2 FROM ({WEEKLY_INDEX}) t"""


@query(
    "weekly_index_scan",
    f"""SELECT k AS postcode, week AS date, round(nullif(v, 0), 6) AS combined, CAST(NULL AS DOUBLE) AS units_2
  FROM ({WEEKLY_INDEX}) t WHERE k % 9 <> 0""",
)
def weekly_index_scan(spark, sf):
    d = T.read_weekly_index(spark, landed(shaped(spark, sf, _INDEX_TEXT), spark, "index"))
    return d.select("postcode", "date", r6("combined", "combined"), "units_2")


@query(
    "stop_geojson_scan",
    f"""SELECT CAST(fid AS VARCHAR) AS stop_id, name AS stop_name, CASE WHEN category = 0 THEN 'METRO TRAM' ELSE 'METRO BUS' END AS stop_mode,
  lat AS stop_lat, lon AS stop_lon FROM ({GEO_RIGHT}) t WHERE fid % 10 <> 0""",
)
def stop_geojson_scan(spark, sf):
    df = shaped(spark, sf, GEO_RIGHT)
    key = F.when(F.col("fid") % 2 == 0, "STOP_ID").otherwise("stop_id")
    props = F.create_map(
        key, F.col("fid").cast("string"), F.lit("STOP_NAME"), F.col("name"),
        F.lit("mode"), F.when(F.col("category") == 0, "Metro Tram ").otherwise("metro bus"),
    )
    geometry = F.struct(
        F.when(F.col("fid") % 10 == 0, "LineString").otherwise("Point").alias("type"),
        F.array("lon", "lat").alias("coordinates"),
    )
    one = df.select(F.array(F.struct(props.alias("properties"), geometry.alias("geometry"))).alias("features"))
    path = new_path(spark, "stops")
    one.write.json(path)
    return J.read_stops(spark, path, lines=True)


@query("attribute_pages_scan", "SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name FROM supplier")
def attribute_pages_scan(spark, sf):
    s = table(spark, sf, "supplier")
    attrs = F.struct(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.lit(1).alias("other"))
    part = F.when(F.col("s_suppkey") % 2 == 0, attrs)
    rest = F.when(F.col("s_suppkey") % 2 == 1, attrs)
    pages = s.select(F.array(F.struct(part.alias("attributes"), rest.alias("properties"))).alias("features"))
    path = new_path(spark, "pages")
    pages.write.json(path)
    return J.read_attribute_pages(spark, path, ["code", "name"], lines=True)


@query(
    "amenity_scan",
    f"""SELECT CASE WHEN category = 0 THEN 'cafe' ELSE 'park' END AS amenity_type, lat AS amenity_lat, lon AS amenity_lon
  FROM ({GEO_RIGHT}) t WHERE fid % 7 <> 0""",
)
def amenity_scan(spark, sf):
    df = shaped(spark, sf, GEO_RIGHT)
    elements = df.select(
        F.when(F.col("category") == 0, "cafe").otherwise("park").alias("label"),
        F.when(F.col("fid") % 3 == 0, F.col("lat")).alias("lat"),
        F.when(F.col("fid") % 3 == 0, F.col("lon")).alias("lon"),
        F.when(F.col("fid") % 3 > 0, F.struct("lat", "lon")).alias("center"),
        F.col("fid"),
    )
    # Every seventh element comes without any coordinates.
    gone = F.col("fid") % 7 == 0
    elements = elements.withColumns({c: F.when(~gone, F.col(c)) for c in ("lat", "lon", "center")})
    path = new_path(spark, "amenities")
    elements.drop("fid").write.partitionBy("label").json(path)
    return J.read_amenities(spark, path, label="label=([^/]+)/", lines=True)


@query(
    "area_polygon_scan",
    f"""WITH v AS ({POLY_DUCK}), e AS (SELECT area_id, lat AS a, lon AS o, lead(lat) OVER w AS a2, lead(lon) OVER w AS o2,
    first_value(lat) OVER w AS a0, first_value(lon) OVER w AS o0, seq FROM v WINDOW w AS (PARTITION BY area_id ORDER BY seq))
  SELECT CAST(area_id AS VARCHAR) AS sa2_code_2021, concat('Area ', area_id) AS sa2_name_2021, 6 AS n_edges,
    round(abs(sum(o * coalesce(a2, a0) - coalesce(o2, o0) * a)) / 2, 6) AS area FROM e WHERE area_id % 5 <> 4 GROUP BY 1, 2""",
)
def area_polygon_scan(spark, sf):
    corners = shaped(spark, sf, POLY_SPARK)
    ring = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.array(p.lon, p.lat)
    )
    kind = F.when(F.col("area_id") % 2 == 0, "Polygon").otherwise("MultiPolygon")
    shapes = corners.groupBy("area_id").agg(ring.alias("r"))
    text = F.when(F.col("area_id") % 2 == 0, F.to_json(F.array("r"))).otherwise(
        F.to_json(F.array(F.array("r")))
    )
    line = F.format_string(
        '{"features":[{"properties":{"sa2_code_2021":"%d.0","sa2_name_2021":"Area %d","state_code_2021":"%s"},'
        '"geometry":{"type":"%s","coordinates":%s}}]}',
        F.col("area_id"), F.col("area_id"), F.when(F.col("area_id") % 5 == 4, "3").otherwise("2"), kind, text,
    )
    path = new_path(spark, "polygons")
    shapes.select(line.alias("value")).write.text(path)
    areas = J.read_area_polygons(spark, path, fields={"sa2_name_2021": "string"}, lines=True)
    return areas.select(
        "sa2_code_2021", "sa2_name_2021", F.size("edges").alias("n_edges"), r6(shoelace(F.col("edges")), "area")
    )


@query("glob_csv_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def glob_csv_scan(spark, sf):
    path = new_path(spark, "extract")
    df = table(spark, sf, "nation").select("n_nationkey", "n_name")
    df.write.option("header", True).csv(f"{path}/inner/G02")
    return T.read_first_match(spark, path, "part-*.csv")


@query(
    "embedded_series",
    """SELECT page_id, CAST(d AS DATE) AS date, v FROM (
    SELECT page_id, concat('2024-01-0', 1 + page_id % 9) AS d, CAST(page_id AS DOUBLE) AS v FROM pages WHERE page_id % 10 <> 0
    UNION ALL SELECT page_id, '2024-02-01', 0e0 FROM pages WHERE page_id % 10 <> 0) t""",
)
def embedded_series(spark, sf):
    return J.embedded_series(shaped(spark, sf, PAGES_SERIES), "page_id", "html", ["v"])


_GRID_SQL = """WITH g AS (SELECT c_nationkey AS k, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS s
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  t AS (SELECT k, y, coalesce(n, 0) AS n, s FROM (SELECT DISTINCT k FROM g) a CROSS JOIN (SELECT DISTINCT y FROM g) b LEFT JOIN g USING (k, y))"""


@query(
    "two_row_header_grid",
    f"""{_GRID_SQL} SELECT k, concat(y, '-', lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')) AS financial_year, 'income_earners' AS measure,
    CASE WHEN n % 5 = 0 THEN NULL ELSE CAST(n AS DOUBLE) END AS value FROM t
  UNION ALL SELECT k, concat(y, '-', lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')), 'income_sum', s FROM t""",
)
def two_row_header_grid(spark, sf):
    t = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("k"))
    )
    years = list(range(1995, 2002))
    n = len(years)

    def with_commas(text, end):
        return F.regexp_replace(text, rf"(?<=\d)(?=(\d{{3}})+{end})", ",")

    def when(y):
        return F.year("o_orderdate") == y

    wide = t.agg(
        *[F.count(F.when(when(y), 1)).alias(f"n{y}") for y in years],
        *[F.round(F.sum(F.when(when(y), F.col("o_totalprice"))), 2).alias(f"s{y}") for y in years],
    )
    body = wide.select(
        "k",
        *[F.when(F.col(f"n{y}") % 5 == 0, "np").otherwise(with_commas(F.col(f"n{y}").cast("string"), "$")).alias(f"c{i}") for i, y in enumerate(years)],
        *[with_commas(F.col(f"s{y}").cast("decimal(18,2)").cast("string"), r"\.").alias(f"c{i + n}") for i, y in enumerate(years)],
    )
    labels = [f"{y}-{(y + 1) % 100:02d}" for y in years]
    titles = {0: "Earners (persons)", n: "Sum ($)"}
    header = [(f"c{i}", titles.get(i), labels[i % n]) for i in range(2 * n)]
    return T.grid_to_long(body, "k", header)


_YEAR_COLUMNS = list(range(1995, 2002))


@query(
    "year_columns_to_long",
    f"""WITH g AS (SELECT n_nationkey AS k, y AS year FROM nation, (SELECT unnest(range(1995, 2002)) AS y) t),
  a AS (SELECT g.k, CAST(g.year AS INT) AS year, CASE WHEN g.year % 4 = 0 THEN NULL ELSE q.v END AS erp FROM g LEFT JOIN ({YEARLY}) q ON g.k = q.k AND g.year = q.yr),
  p AS (SELECT *, last_value(erp IGNORE NULLS) OVER (PARTITION BY k ORDER BY year) AS f FROM a)
  SELECT k, year, erp, round(100 * (f / lag(f) OVER (PARTITION BY k ORDER BY year) - 1), 6) AS erp_growth_pct FROM p""",
)
def year_columns_to_long(spark, sf):
    y = shaped(spark, sf, YEARLY)
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    wide = y.groupBy("k").agg(
        *[F.max(F.when((F.col("yr") == v) & (F.col("yr") % 4 != 0), F.col("v"))).alias(str(v)) for v in _YEAR_COLUMNS]
    )
    long = T.years_to_long(nations.join(wide, "k", "left"), "k", "erp")
    out = with_padded_change(long, "k", "year", "erp", "erp_growth_pct")
    return out.select("k", "year", "erp", r6("erp_growth_pct", "erp_growth_pct"))


@query("positional_projection", "SELECT l_orderkey AS code, l_quantity AS a, l_shipdate AS b FROM lineitem")
def positional_projection(spark, sf):
    df = table(spark, sf, "lineitem")
    at = [df.columns.index(c) for c in ("l_orderkey", "l_quantity", "l_shipdate")]
    return T.positional(df, at, ["code", "a", "b"])


@query("table_sinks", "SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def table_sinks(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    as_parquet = spark.read.parquet(
        landed(df.drop("o_totalprice"), spark, "orders", "parquet", partition_by=["o_orderstatus"])
    )
    as_csv = T.type_columns(
        T.read_text_table(spark, landed(df.select("o_orderkey", "o_totalprice"), spark, "prices")),
        numbers=["o_totalprice"],
    ).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))
    return as_parquet.join(as_csv, "o_orderkey").select(*df.columns)


@query(
    "intermediate_table",
    "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1",
)
def intermediate_table(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")
    )
    return materialise(sums, "supplier_sums")


@query(
    "area_snapshot",
    """SELECT CAST(210000000 + c_custkey AS VARCHAR) AS sa2_code_2021, c_acctbal AS irsad_score, CAST(c_nationkey AS DOUBLE) AS erp_2025
  FROM customer WHERE c_custkey % 4 <> 0""",
)
def area_snapshot(spark, sf):
    k = F.col("c_custkey")
    raw = table(spark, sf, "customer").withColumn(
        "CODE", F.concat(F.when(k % 4 == 0, k + 310000000).otherwise(k + 210000000).cast("string"), F.lit(".0"))
    )
    return T.snapshot(raw, "CODE", {"c_acctbal": "irsad_score", "c_nationkey": "erp_2025"})
