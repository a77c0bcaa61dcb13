"""Coverage audits (Q1-Q5)."""

from pyspark.sql import functions as F

from gridmere.catalog.registry import WEEKLY_INDEX, query, shaped, table
from gridmere.operators import quality as Q
from gridmere.operators.tables import union_all


def _gate(keys: str, name: str) -> str:
    return f"""SELECT '{name}' AS source, m AS area_matches, t AS area_total, CASE WHEN m >= 0.9e0 * t THEN 'joined' ELSE 'failed' END AS status,
  concat(m, '/', t, ' areas matched (', CAST(round(100e0 * m / t, 1) AS VARCHAR), '%)') AS detail
  FROM (SELECT count(*) FILTER (n_nationkey IN ({keys})) AS m, count(*) AS t FROM nation) q"""


_CUSTOMERS = "SELECT c_nationkey FROM customer"
_SUPPLIERS = "SELECT s_nationkey + 12 FROM supplier"


@query("match_rate_gate", f"{_gate(_CUSTOMERS, 'customers')} UNION ALL {_gate(_SUPPLIERS, 'suppliers')}")
def match_rate_gate(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") + 12).alias("k"))
    return union_all([Q.match_gate(nations, c, "k", "customers"), Q.match_gate(nations, s, "k", "suppliers")])


@query(
    "source_coverage",
    f"""{_gate(_CUSTOMERS, 'customers')} UNION ALL SELECT 'orders', NULL, count(*), CASE WHEN count(*) > 0 THEN 'joined' ELSE 'failed' END, concat(count(*), ' rows') FROM orders
  UNION ALL SELECT 'events', NULL, NULL, 'skipped', concat(count(*), ' rows unused') FROM events""",
)
def source_coverage(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    n = F.col("n")
    orders = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"))
    events = table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(n > 0, "joined").otherwise("failed")
    return union_all(
        [
            Q.match_gate(nations, c, "k", "customers"),
            Q.coverage_row(orders, "orders", status, F.concat(n.cast("string"), F.lit(" rows")), total=n),
            Q.coverage_row(events, "events", "skipped", F.concat(n.cast("string"), F.lit(" rows unused"))),
        ]
    )


_HOLES = """SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN l_tax END AS part_filled, CAST(NULL AS DOUBLE) AS none FROM lineitem"""


@query("empty_columns", f"""SELECT 'none' AS "column" WHERE (SELECT count(none) FROM ({_HOLES}) t) = 0""")
def empty_columns(spark, sf):
    return Q.empty_columns(shaped(spark, sf, _HOLES))


@query(
    "non_null_rates",
    f"""WITH t AS ({_HOLES}) SELECT 'l_orderkey' AS "column", count(*) AS rows, count(l_orderkey) AS filled, round(count(l_orderkey) / count(*), 6) AS rate FROM t
  UNION ALL SELECT 'part_filled', count(*), count(part_filled), round(count(part_filled) / count(*), 6) FROM t UNION ALL SELECT 'none', count(*), count(none), round(count(none) / count(*), 6) FROM t""",
)
def non_null_rates(spark, sf):
    return Q.non_null_rates(shaped(spark, sf, _HOLES)).withColumn("rate", F.round("rate", 6))


@query(
    "series_coverage",
    f"""WITH s AS ({WEEKLY_INDEX}), h AS (SELECT k + 8 AS k, count(*) AS n, min(week) AS a, max(week) AS b FROM s GROUP BY 1)
  SELECT n_nationkey AS k, coalesce(n, 0) AS n_weeks, a AS first_date, b AS last_date, CASE WHEN n IS NULL THEN 'no series on page' ELSE 'ok' END AS status
  FROM nation LEFT JOIN h ON n_nationkey = k""",
)
def series_coverage(spark, sf):
    wanted = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return Q.series_coverage(shaped(spark, sf, WEEKLY_INDEX).withColumn("k", F.col("k") + 8), wanted, "k", "week")


