"""Crosswalks, releases and trends."""

from pyspark.sql import functions as F

from gridmere.catalog.registry import BRIDGE, YEARLY, query, r6, shaped, table
from gridmere.operators.crosswalk import (
    build_correspondence, rescale_release, share_sums, weighted_values,
)
from gridmere.operators.trend import monthly_trend, yearly_trend

_BLOCKS = """SELECT s_nationkey AS area_a, p_brand AS area_b, CASE WHEN l_linenumber = 7 THEN NULL ELSE p_type END AS area_c,
  CASE WHEN p_brand IN ('Brand#2', 'Brand#4') THEN 0e0 ELSE l_quantity END AS dwellings, l_extendedprice AS area_sqkm
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""


def _share(of: str, name: str) -> str:
    return f"""round(coalesce(w / nullif(sum(w) OVER (PARTITION BY {of}), 0), s / nullif(sum(s) OVER (PARTITION BY {of}), 0)), 8) AS {name}"""


@query(
    "correspondence",
    f"""WITH g AS (SELECT area_a, area_b, area_c, sum(dwellings) AS w, sum(area_sqkm) AS s FROM ({_BLOCKS}) t WHERE area_c IS NOT NULL GROUP BY 1, 2, 3)
  SELECT area_a, area_b, area_c, round(w, 2) AS dwellings_2021, round(s, 2) AS area, {_share('area_a', 'share_a')}, {_share('area_b', 'share_b')}, {_share('area_c', 'share_c')} FROM g""",
)
def correspondence(spark, sf):
    out = build_correspondence(
        shaped(spark, sf, _BLOCKS), ["area_a", "area_b", "area_c"],
        {"dwellings": "dwellings_2021", "area_sqkm": "area"},
        {"area_a": "share_a", "area_b": "share_b", "area_c": "share_c"}, "dwellings", "area_sqkm",
    )
    return out.select(
        "area_a", "area_b", "area_c", *[F.round(c, 2).alias(c) for c in ("dwellings_2021", "area")],
        *[F.round(c, 8).alias(c) for c in ("share_a", "share_b", "share_c")],
    )


# Values per source area; some are missing in one column, the first three areas in both.
_VALUES = """SELECT c_nationkey + 3 AS area_a, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE avg(c_acctbal) END AS v1,
  CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE count(*) + 0e0 END AS v2 FROM customer GROUP BY c_nationkey"""
_SHARED = f"""SELECT area_a, area_b, area_c, w, coalesce(w / nullif(sum(w) OVER (PARTITION BY area_b), 0),
  area_size / nullif(sum(area_size) OVER (PARTITION BY area_b), 0)) AS share FROM ({BRIDGE}) t"""


@query(
    "weighted_crosswalk",
    f"""WITH b AS ({_SHARED}), wt AS (SELECT area_b, area_a, sum(share) AS w FROM b GROUP BY 1, 2), v AS ({_VALUES})
  SELECT area_b, round(sum(w * v1) / nullif(sum(w) FILTER (v1 IS NOT NULL), 0), 6) AS v1, round(sum(w * v2) / nullif(sum(w) FILTER (v2 IS NOT NULL), 0), 6) AS v2,
    round(coalesce(sum(w) FILTER (v1 IS NOT NULL), 0) / sum(w), 8) AS coverage FROM wt LEFT JOIN v ON wt.area_a = v.area_a GROUP BY 1""",
)
def weighted_crosswalk(spark, sf):
    from gridmere.operators.tables import with_shares

    bridge = with_shares(shaped(spark, sf, BRIDGE), {"area_b": "share"}, "w", "area_size")
    out = weighted_values(bridge, shaped(spark, sf, _VALUES), "area_b", "area_a", "share")
    return out.select("area_b", r6("v1", "v1"), r6("v2", "v2"), F.round("coverage", 8).alias("coverage"))


@query(
    "plain_crosswalk",
    f"""WITH b AS ({_SHARED}), v AS ({_VALUES}) SELECT area_b, round(sum(share * v1), 6) AS v1, round(sum(share * v2), 6) AS v2 FROM b LEFT JOIN v ON b.area_a = v.area_a GROUP BY 1""",
)
def plain_crosswalk(spark, sf):
    from gridmere.operators.tables import with_shares

    bridge = with_shares(shaped(spark, sf, BRIDGE), {"area_b": "share"}, "w", "area_size")
    out = share_sums(bridge, shaped(spark, sf, _VALUES), "area_b", "area_a", "share")
    return out.select("area_b", r6("v1", "v1"), r6("v2", "v2"))


@query(
    "release_rescale",
    f"""WITH n AS ({YEARLY}), o AS (SELECT k, yr, v * (1 + k / 100e0) AS v FROM n WHERE yr <= 1998 AND NOT (k = 7 AND yr >= 1996)),
  nn AS (SELECT * FROM n WHERE yr >= 1996),
  f AS (SELECT o.k, median(nn.v / o.v) AS f FROM o JOIN nn ON o.k = nn.k AND o.yr = nn.yr GROUP BY 1)
  SELECT o.k, o.yr, round(o.v * f.f, 4) AS v, 'old (rescaled)' AS release FROM o LEFT JOIN f ON o.k = f.k""",
)
def release_rescale(spark, sf):
    y = shaped(spark, sf, YEARLY)
    gone = (F.col("k") == 7) & (F.col("yr") >= 1996)
    old = y.where((F.col("yr") <= 1998) & ~gone).withColumns(
        {"v": F.col("v") * (1 + F.col("k") / 100), "release": F.lit("old")}
    )
    new = y.where(F.col("yr") >= 1996).withColumn("release", F.lit("new"))
    out = rescale_release(old, new, "k", "yr", ["v"], "release")
    return out.select("k", "yr", F.round("v", 4).alias("v"), "release")


@query(
    "release_unchanged",
    f"SELECT k, yr, v, 'old' AS release FROM ({YEARLY}) t WHERE yr <= 1998",
)
def release_unchanged(spark, sf):
    y = shaped(spark, sf, YEARLY)
    old = y.where(F.col("yr") <= 1998).withColumn("release", F.lit("old"))
    return rescale_release(old, y.withColumn("release", F.lit("new")), "k", "yr", ["v"], "release")


_TREND_IN = """SELECT o_custkey % 60 AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_custkey % 60 = 5 THEN 100e0
  ELSE o_totalprice * exp(0.0001e0 * (o_custkey % 60) * date_diff({part} CAST('1995-01-01' AS DATE), CAST(o_orderdate AS DATE)) / 365) END AS v FROM orders"""


def _trend_rows(spark, sf):
    k = F.col("o_custkey") % 60
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    v = F.when(k == 5, F.lit(100.0)).otherwise(F.col("o_totalprice") * F.exp(0.0001 * k * days / 365))
    return table(spark, sf, "orders").select(k.alias("k"), F.col("o_orderdate").cast("date").alias("d"), v.alias("v"))


@query(
    "monthly_trend",
    f"""WITH t AS ({_TREND_IN.format(part="'day',")}), m AS (SELECT k, date_trunc('month', d) AS month, avg(v) AS v FROM t GROUP BY 1, 2),
  r AS (SELECT *, date_diff('day', CAST('1970-01-01' AS DATE), CAST(month AS DATE)) / 365.25e0 AS x FROM m WHERE month >= (SELECT max(month) FROM m) - INTERVAL 3 YEAR),
  f AS (SELECT k, regr_slope(ln(v), x) AS slope, regr_r2(ln(v), x) AS r2, min(v) AS lo, max(v) AS hi, count(*) AS n, count(DISTINCT v) AS u, max_by(v, month) AS cur FROM r GROUP BY 1)
  SELECT k, round((exp(slope) - 1) * 100, 5) AS rent_growth_pct, CASE WHEN hi > lo THEN round(r2, 6) END AS trend_r2, n AS trend_n_months, round(cur, 6) AS current_market_rent
  FROM f WHERE n >= 30 AND u >= 0.4e0 * n AND abs((exp(slope) - 1) * 100) <= 20""",
)
def monthly_trend_query(spark, sf):
    out = monthly_trend(_trend_rows(spark, sf), "k", "d", "v")
    return out.select(
        "k", F.round("rent_growth_pct", 5).alias("rent_growth_pct"), r6("trend_r2", "trend_r2"),
        "trend_n_months", r6("current_market_rent", "current_market_rent"),
    )


@query(
    "yearly_trend",
    f"""WITH d AS (SELECT k, yr, v FROM ({YEARLY}) t WHERE v > 0), r AS (SELECT * FROM d WHERE yr >= (SELECT max(yr) FROM d) - 5)
  SELECT k, round((exp(regr_slope(ln(v), CAST(yr AS DOUBLE))) - 1) * 100, 5) AS cagr FROM r GROUP BY 1 HAVING count(*) >= 3""",
)
def yearly_trend_query(spark, sf):
    out = yearly_trend(shaped(spark, sf, YEARLY), "k", "yr", "v", "cagr")
    return out.select("k", F.round("cagr", 5).alias("cagr"))
