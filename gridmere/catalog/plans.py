"""The composed programs over the given tables: master build and suburb growth."""

from pyspark.sql import functions as F

from gridmere.catalog.places import _HAV, _inside_sql
from gridmere.catalog.registry import (
    GEO_LEFT, GEO_RIGHT, LOT_DUCK, LOT_SPARK, POLY_DUCK, POLY_SPARK, WEEKLY_INDEX, query, r6, shaped,
)
from gridmere.operators.polygons import edges_from_vertices
from gridmere.plans import enrich, growth

_LISTINGS = f"""SELECT CAST(o_orderkey AS STRING) AS listing_id, concat('Place ', o_custkey % 40) AS suburb, CAST(3000 + c_nationkey AS BIGINT) AS postcode,
  o_totalprice / 500 AS weekly_rent, CAST(o_orderdate AS DATE) AS date_listed, CAST(o_custkey % 5 AS DOUBLE) AS bedrooms,
  CASE o_orderkey % 3 WHEN 0 THEN 'House' WHEN 1 THEN 'Studio' END AS property_type, o_custkey AS id, g.lat, g.lon
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN ({GEO_LEFT}) g ON o_custkey = g.id"""

_BLOCKS = """SELECT concat('2', lpad(CAST(c_custkey AS STRING), 10, '0')) AS mb_code, CAST(206000000 + c_nationkey AS STRING) AS sa2_code_2021,
  concat('Area ', c_nationkey) AS sa2_name_2021, CAST(20000 + c_custkey % 40 AS STRING) AS sal_code_2021, concat('Place ', c_custkey % 40) AS sal_name_2021,
  CAST(3000 + c_nationkey AS STRING) AS postcode, 1e0 AS area_sqkm, CASE WHEN c_custkey % 40 = 3 THEN 0e0 ELSE CAST(c_custkey % 90 AS DOUBLE) END AS dwellings,
  CAST(c_custkey % 200 AS DOUBLE) AS persons FROM customer"""

_MASTER_SQL = f"""{_inside_sql(f'SELECT id, lat, lon FROM ({GEO_LEFT}) q', POLY_DUCK, 'area_id')}, li AS ({_LISTINGS}), l AS ({GEO_LEFT}), r AS ({GEO_RIGHT}),
  near AS (SELECT l.id, min({_HAV}) AS h FROM l CROSS JOIN r GROUP BY 1),
  sch AS (SELECT r.fid, e.area_id FROM r JOIN e ON (e.a1 > r.lat) <> (e.a2 > r.lat) AND r.lon < e.o1 + (r.lat - e.a1) / (e.a2 - e.a1) * (e.o2 - e.o1) GROUP BY 1, 2 HAVING count(*) % 2 = 1),
  cnt AS (SELECT area_id, count(*) AS c FROM sch GROUP BY 1),
  lv AS ({LOT_DUCK}), le AS (SELECT lot_id, lat AS a1, lon AS o1, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS a2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS o2 FROM lv WINDOW w AS (PARTITION BY lot_id ORDER BY seq)),
  ls AS (SELECT lot_id, abs(sum(o1 * a2 - o2 * a1)) / 2 AS area FROM le GROUP BY 1),
  lh AS (SELECT l.id, le.lot_id FROM l JOIN le ON (le.a1 > l.lat) <> (le.a2 > l.lat) AND l.lon < le.o1 + (l.lat - le.a1) / (le.a2 - le.a1) * (le.o2 - le.o1) GROUP BY 1, 2 HAVING count(*) % 2 = 1),
  lr AS (SELECT id, area, row_number() OVER (PARTITION BY id ORDER BY area) AS rn FROM lh JOIN ls USING (lot_id)),
  lot AS (SELECT id, CAST(coalesce(max(CASE WHEN rn = 2 THEN area END) <= min(area) * 1.01e0, false) AS INT) AS shared FROM lr WHERE rn <= 2 GROUP BY 1),
  ix AS (SELECT 3000 + k AS postcode, week, nullif(v, 0) AS v FROM ({WEEKLY_INDEX}) t),
  j AS (SELECT li.*, ix.week, ix.v FROM li ASOF LEFT JOIN ix ON li.postcode = ix.postcode AND li.date_listed >= ix.week),
  m AS (SELECT *, CASE WHEN date_diff('day', week, date_listed) <= 31 THEN date_diff('day', week, date_listed) END AS lag,
    CASE WHEN date_diff('day', week, date_listed) <= 31 THEN CASE WHEN property_type = 'House' THEN v * 1.1e0 WHEN property_type IS NULL THEN v END END AS market FROM j)
  SELECT listing_id, CAST(20000 + m.id % 40 AS VARCHAR) AS sal_code_2021, CASE WHEN hit.area_id IS NOT NULL THEN CAST(206000000 + hit.area_id AS VARCHAR) END AS sa2_code_2021,
    round(2 * 6371.0088e0 * asin(sqrt(h)), 6) AS nearest_school_km, CASE WHEN hit.area_id IS NOT NULL THEN coalesce(c, 0) END AS school_count, shared AS land_lot_shared,
    CAST(lag AS INT) AS sqm_week_lag_days, round(market, 5) AS sqm_market_rent, round(nullif(weekly_rent, 0) / nullif(market, 0), 6) AS rent_vs_sqm_market
  FROM m JOIN near ON m.id = near.id LEFT JOIN hit ON m.id = hit.id LEFT JOIN cnt ON hit.area_id = cnt.area_id LEFT JOIN lot ON m.id = lot.id"""


def _area_code(c):
    return (F.col(c) + 206000000).cast("string")


def _built(spark, sf):
    v = F.nullif(F.col("v"), F.lit(0.0))
    index = shaped(spark, sf, WEEKLY_INDEX).select(
        (F.col("k") + 3000).cast("long").alias("postcode"), F.col("week").alias("date"),
        (v * 1.1).alias("houses_all"), v.alias("combined"),
    )
    areas = edges_from_vertices(shaped(spark, sf, POLY_SPARK), "area_id", "seq").select(
        _area_code("area_id").alias("sa2_code_2021"), F.lit(1.0).alias("area_albers_sqkm"), "edges"
    )
    return enrich.build_master(
        enrich.Sources(
            listings=shaped(spark, sf, _LISTINGS).drop("id"),
            areas=areas,
            blocks=shaped(spark, sf, _BLOCKS),
            schools=shaped(spark, sf, GEO_RIGHT).select(
                F.col("fid").alias("school_id"), F.col("lat").alias("school_lat"), F.col("lon").alias("school_lon")
            ),
            lots=edges_from_vertices(shaped(spark, sf, LOT_SPARK), "lot_id", "seq").withColumnRenamed("lot_id", "prop_pfi"),
            index=index,
        )
    )


@query("master_table", _MASTER_SQL)
def master_table(spark, sf):
    tables = _built(spark, sf)
    return tables.master.join(tables.rent_ratios, "listing_id").select(
        "listing_id", "sal_code_2021", "sa2_code_2021", r6("nearest_school_km", "nearest_school_km"), "school_count",
        "land_lot_shared", "sqm_week_lag_days", F.round("sqm_market_rent", 5).alias("sqm_market_rent"),
        r6("rent_vs_sqm_market", "rent_vs_sqm_market"),
    )


@query(
    "audited_build",
    f"""SELECT 'school points' AS source, 'joined' AS status, concat(count(*), ' points') AS detail FROM ({GEO_RIGHT}) t
  UNION ALL SELECT 'weekly rent index', 'joined', concat(count(*), ' postcode weeks') FROM ({WEEKLY_INDEX}) t
  UNION ALL SELECT s, 'skipped', 'not supplied' FROM (SELECT unnest(['area population by year', 'area income by year', 'driving routes', 'amenities', 'incidents']) AS s) q""",
)
def audited_build(spark, sf):
    told = F.col("status") == "skipped"
    return _built(spark, sf).coverage.where(told | F.col("source").isin("school points", "weekly rent index")).select(
        "source", "status", "detail"
    )


_INDEX = """SELECT CAST(3000 + c_nationkey AS STRING) AS postcode, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN c_nationkey % 6 <> 5 THEN o_totalprice END AS combined FROM orders JOIN customer ON o_custkey = c_custkey"""
_AREAS = "SELECT CAST(206000000 + c_nationkey AS STRING) AS sa2_code_2021, avg(c_acctbal) AS irsad_score, count(*) AS school_count FROM customer GROUP BY 1"
_YEARS = """SELECT CAST(206000000 + c_nationkey AS STRING) AS sa2_code_2021, CAST(year(o_orderdate) AS INT) AS year, CAST(count(*) AS DOUBLE) AS erp,
  CASE WHEN c_nationkey % 4 = 1 THEN NULL ELSE avg(o_totalprice) END AS income_median FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, c_nationkey"""

_GROWTH_SQL = f"""WITH g AS (SELECT sal_code_2021, sal_name_2021, postcode, sa2_code_2021, sum(dwellings) AS w, sum(area_sqkm) AS s FROM ({_BLOCKS}) b GROUP BY 1, 2, 3, 4),
  b AS (SELECT *, coalesce(w / nullif(sum(w) OVER (PARTITION BY sal_code_2021), 0), s / nullif(sum(s) OVER (PARTITION BY sal_code_2021), 0)) AS share FROM g),
  mo AS (SELECT postcode, date_trunc('month', date) AS month, avg(combined) AS v FROM ({_INDEX}) t WHERE combined IS NOT NULL GROUP BY 1, 2),
  re AS (SELECT *, date_diff('day', CAST('1970-01-01' AS DATE), CAST(month AS DATE)) / 365.25e0 AS x FROM mo WHERE month >= (SELECT max(month) FROM mo) - INTERVAL 3 YEAR),
  tr AS (SELECT postcode, (exp(regr_slope(ln(v), x)) - 1) * 100 AS growth, count(*) AS n, count(DISTINCT v) AS u FROM re GROUP BY 1),
  ok AS (SELECT postcode, growth FROM tr WHERE n >= 30 AND u >= 0.4e0 * n AND abs(growth) <= 20),
  wp AS (SELECT sal_code_2021, sal_name_2021, postcode, sum(share) AS w FROM b GROUP BY 1, 2, 3),
  t1 AS (SELECT sal_code_2021, sum(w * growth) / nullif(sum(w) FILTER (growth IS NOT NULL), 0) AS growth, coalesce(sum(w) FILTER (growth IS NOT NULL), 0) / sum(w) AS cov FROM wp LEFT JOIN ok USING (postcode) GROUP BY 1),
  wa AS (SELECT sal_code_2021, sa2_code_2021, sum(share) AS w FROM b GROUP BY 1, 2),
  t2 AS (SELECT sal_code_2021, sum(w * irsad_score) / sum(w) AS irsad, sum(w * school_count) / sum(w) AS schools FROM wa JOIN ({_AREAS}) a USING (sa2_code_2021) GROUP BY 1),
  y AS ({_YEARS}), e AS (SELECT * FROM y WHERE erp > 0 AND year >= (SELECT max(year) FROM y WHERE erp > 0) - 5), i AS (SELECT * FROM y WHERE income_median > 0 AND year >= (SELECT max(year) FROM y WHERE income_median > 0) - 5),
  c1 AS (SELECT sa2_code_2021, (exp(regr_slope(ln(erp), CAST(year AS DOUBLE))) - 1) * 100 AS p FROM e GROUP BY 1 HAVING count(*) >= 3),
  c2 AS (SELECT sa2_code_2021, (exp(regr_slope(ln(income_median), CAST(year AS DOUBLE))) - 1) * 100 AS q FROM i GROUP BY 1 HAVING count(*) >= 3),
  t3 AS (SELECT sal_code_2021, sum(w * p) / nullif(sum(w) FILTER (p IS NOT NULL), 0) AS p, sum(w * q) / nullif(sum(w) FILTER (q IS NOT NULL), 0) AS q FROM wa LEFT JOIN c1 USING (sa2_code_2021) LEFT JOIN c2 USING (sa2_code_2021) GROUP BY 1),
  dw AS (SELECT sal_code_2021, sum(w) AS d FROM g GROUP BY 1)
  SELECT t1.sal_code_2021, round(growth, 5) AS rent_growth_pct, round(cov, 8) AS sqm_coverage, round(irsad, 6) AS irsad_score, round(schools, 6) AS school_count,
    round(p, 5) AS erp_cagr_pct, round(q, 5) AS income_median_cagr_pct, round(d, 2) AS dwellings_2021
  FROM t1 JOIN t2 USING (sal_code_2021) JOIN t3 USING (sal_code_2021) JOIN dw USING (sal_code_2021)"""


@query("suburb_growth_table", _GROWTH_SQL)
def suburb_growth_table(spark, sf):
    out = growth.build_suburbs(
        enrich.suburb_bridge(shaped(spark, sf, _BLOCKS)), shaped(spark, sf, _INDEX), shaped(spark, sf, _AREAS),
        shaped(spark, sf, _YEARS), features=["irsad_score", "school_count"],
    )
    return out.select(
        "sal_code_2021", F.round("rent_growth_pct", 5).alias("rent_growth_pct"), F.round("sqm_coverage", 8).alias("sqm_coverage"),
        r6("irsad_score", "irsad_score"), r6("school_count", "school_count"), F.round("erp_cagr_pct", 5).alias("erp_cagr_pct"),
        F.round("income_median_cagr_pct", 5).alias("income_median_cagr_pct"), F.round("dwellings_2021", 2).alias("dwellings_2021"),
    )
