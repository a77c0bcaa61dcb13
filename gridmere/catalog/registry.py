"""Registration, table access, and the projections that shape the tables as inputs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def query(name: str, oracle: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def shaped(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """A projection below, run by Spark over the table files."""
    names = "|".join(TABLES)
    return spark.sql(
        re.sub(
            rf"\b(FROM|JOIN)\s+({names})\b",
            lambda m: f"{m[1]} parquet.`{sf.rstrip('/')}/{m[2]}.parquet`",
            sql,
        )
    )


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def r6(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


# --- projections: the same text runs in Spark and DuckDB ---------------------

GEO_LEFT = """SELECT c_custkey AS id,
  -38.0e0 + ((c_custkey * 7919) % 10007) * 2.0e0 / 10007 AS lat,
  144.0e0 + ((c_custkey * 104729) % 10009) * 2.0e0 / 10009 AS lon FROM customer"""

GEO_RIGHT = """SELECT s_suppkey AS fid, s_nationkey % 5 AS category,
  concat('Stop ', s_suppkey % 10) AS name,
  -38.0e0 + ((s_suppkey * 6007) % 9973) * 2.0e0 / 9973 AS lat,
  144.0e0 + ((s_suppkey * 50021) % 9967) * 2.0e0 / 9967 AS lon FROM supplier"""

POLY_VERTICES = """SELECT n_nationkey AS area_id, v AS seq,
  -38e0 + 0.4e0 * floor(n_nationkey / 5e0) + 0.00037e0 + CASE v WHEN 0 THEN 0e0 WHEN 1 THEN 0e0
    WHEN 2 THEN 0.18e0 WHEN 3 THEN 0.18e0 ELSE 0.36e0 END AS lat,
  144e0 + 0.4e0 * (n_nationkey % 5) + 0.00041e0 + CASE v WHEN 0 THEN 0e0 WHEN 1 THEN 0.36e0
    WHEN 2 THEN 0.36e0 WHEN 3 THEN 0.18e0 WHEN 4 THEN 0.18e0 ELSE 0e0 END AS lon
  FROM (SELECT n_nationkey, unnest_v AS v FROM nation {explode})"""

# One row per polygon corner: both engines explode a literal list.
POLY_SPARK = POLY_VERTICES.format(explode="LATERAL VIEW explode(array(0, 1, 2, 3, 4, 5)) t AS unnest_v")
POLY_DUCK = POLY_VERTICES.format(explode=", (SELECT unnest([0, 1, 2, 3, 4, 5]) AS unnest_v) t")

# The L shapes, a square inside each, and that square again for even areas.
LOT_SHAPES = """SELECT CASE WHEN kind = 0 THEN n_nationkey ELSE n_nationkey + 100 * kind END AS lot_id,
  v AS seq,
  -38e0 + 0.4e0 * floor(n_nationkey / 5e0) + 0.00037e0 + CASE WHEN kind = 0 THEN
    CASE v WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 WHEN 2 THEN 0.18e0 WHEN 3 THEN 0.18e0 ELSE 0.36e0 END
    ELSE CASE v WHEN 0 THEN 0.02e0 WHEN 1 THEN 0.02e0 ELSE 0.1213e0 END END AS lat,
  144e0 + 0.4e0 * (n_nationkey % 5) + 0.00041e0 + CASE WHEN kind = 0 THEN
    CASE v WHEN 0 THEN 0e0 WHEN 1 THEN 0.36e0 WHEN 2 THEN 0.36e0 WHEN 3 THEN 0.18e0 WHEN 4 THEN 0.18e0 ELSE 0e0 END
    ELSE CASE v WHEN 0 THEN 0.02e0 WHEN 3 THEN 0.02e0 ELSE 0.1217e0 END END AS lon
  FROM (SELECT n_nationkey, k AS kind, v FROM nation {explode})
  WHERE (kind = 0 AND v < 6) OR (kind = 1 AND v < 4) OR (kind = 2 AND v < 4 AND n_nationkey % 2 = 0)"""
LOT_SPARK = LOT_SHAPES.format(
    explode="LATERAL VIEW explode(array(0, 1, 2)) a AS k LATERAL VIEW explode(array(0, 1, 2, 3, 4, 5)) b AS v"
)
LOT_DUCK = LOT_SHAPES.format(
    explode=", (SELECT unnest([0, 1, 2]) AS k) a, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS v) b"
)

WEEKLY_INDEX = """SELECT c_nationkey AS k, CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
  CASE WHEN count(*) % 7 = 0 THEN 0e0 ELSE avg(o_totalprice) END AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""

ASOF_LEFT = "SELECT event_id, user_id AS k, ts FROM events WHERE event_type = 'purchase'"
ASOF_RIGHT = "SELECT user_id AS k, ts AS rts, value AS v FROM events WHERE event_type = 'click'"

BRIDGE = """SELECT s_nationkey AS area_a, p_brand AS area_b, p_type AS area_c,
  sum(CASE WHEN p_brand IN ('Brand#2', 'Brand#4') THEN 0e0 ELSE l_quantity END) AS w,
  sum(l_extendedprice) AS area_size
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3"""

YEARLY = """SELECT c_nationkey AS k, CAST(year(o_orderdate) AS INT) AS yr, round(sum(o_totalprice), 2) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""

INCIDENTS = """SELECT user_id % 20 AS postcode, user_id % 7 AS name_key, user_id % 3 AS parent,
  event_type AS division, CAST(ts AS DATE) AS period, count(*) AS n
  FROM events GROUP BY 1, 2, 3, 4, 5"""

LABELS_TEXT = """SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN NULL
  ELSE concat(p_type, ', ', p_name, ',  ', p_brand) END AS raw FROM part"""

CLEAN_IN = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN 0e0
  WHEN o_orderkey % 211 = 0 THEN 808500e0 ELSE o_totalprice / 250 END AS target,
  o_orderpriority AS category,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 15 END AS a1,
  o_orderkey % 11 AS a2,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 17 END AS a3,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE concat(o_custkey % 40,
    CASE WHEN o_orderkey % 2 = 0 THEN ' South Ave' ELSE ' South Avenue' END) END AS address
  FROM orders"""

# The same rows under the listing table's column names.
CLEAN_LISTINGS = f"""SELECT id AS listing_id, target AS weekly_rent,
  CASE category WHEN '1-URGENT' THEN 'Car Space' WHEN '2-HIGH' THEN NULL ELSE category END AS property_type,
  CAST(a1 AS DOUBLE) AS bedrooms, CAST(a2 AS DOUBLE) AS bathrooms, CAST(a3 AS DOUBLE) AS carspaces,
  d AS date_listed, address, CAST(3000 + id % 3 AS STRING) AS postcode,
  CASE WHEN id % 31 = 0 THEN NULL WHEN id % 37 = 0 THEN -12e0 ELSE -38e0 + (id % 100) / 100e0 END AS lat,
  CASE WHEN id % 41 = 0 THEN NULL ELSE 144e0 + (id % 90) / 100e0 END AS lon
  FROM ({CLEAN_IN}) t"""

# Routes between customers and the suppliers they have bought from.
ROUTES = """SELECT origin, dest,
  CASE WHEN (origin + dest) % 17 = 0 THEN NULL ELSE ((origin * 31 + dest * 17) % 1000) / 10e0 END AS drive_km,
  CASE WHEN (origin + dest) % 17 = 0 THEN NULL ELSE ((origin * 13 + dest * 29) % 900) / 10e0 END AS drive_min
  FROM (SELECT DISTINCT o_custkey AS origin, l_suppkey AS dest FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t"""

PAGES_SERIES = """SELECT page_id, CASE WHEN page_id % 10 = 0 THEN html ELSE concat(html,
  '<script>var s=[{"date":"2024-01-0', CAST(1 + page_id % 9 AS STRING), '","v":', CAST(page_id AS STRING),
  '},{"date":"2024-02-01","v":0}];</script>') END AS html FROM pages"""

LISTING_TEXT = """SELECT CAST(o_orderkey AS STRING) AS listing_id,
  concat('Suburb ', o_custkey % 40) AS suburb,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(3000 + o_custkey % 20 AS STRING) END AS postcode,
  CASE WHEN o_orderkey % 97 = 0 THEN 'np' WHEN o_orderkey % 89 = 0 THEN NULL
    ELSE CAST(100 + o_orderkey % 3000 AS STRING) END AS weekly_rent,
  CASE WHEN o_orderkey % 19 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_listed,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 15 AS STRING) END AS bedrooms,
  o_orderpriority AS property_type,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat(
    CASE o_orderkey % 4 WHEN 0 THEN 'Built-in wardrobes' WHEN 1 THEN 'Air conditioning' WHEN 2 THEN 'Bath' ELSE 'Gym' END,
    CASE o_custkey % 3 WHEN 0 THEN ',  Swimming Pool' WHEN 1 THEN ', Secure parking, Pets Allowed' ELSE ',Furnished' END)
    END AS structured_features,
  o_orderstatus AS scraper_note FROM orders"""
