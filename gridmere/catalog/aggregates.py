"""Groupings and statistics (A)."""

from pyspark.sql import functions as F

from gridmere.catalog.registry import GEO_LEFT, GEO_RIGHT, INCIDENTS, query, r6, shaped, table
from gridmere.operators import tables as T
from gridmere.operators.correlation import pearson_pairs, spearman_pairs
from gridmere.operators.incidents import incident_rates


@query(
    "sum_on_five_keys",
    """SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c, p_brand AS d, p_type AS e, round(sum(l_quantity), 2) AS w, round(sum(l_extendedprice), 2) AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 5 GROUP BY ALL""",
)
def sum_on_five_keys(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"),
        F.when(F.col("l_linenumber") != 5, F.col("l_linenumber")).alias("c"),
        F.col("p_brand").alias("d"), F.col("p_type").alias("e"), "l_quantity", "l_extendedprice",
    )
    sums = T.sum_by(rows, list("abcde"), {"l_quantity": "w", "l_extendedprice": "s"})
    return sums.select(*"abcde", F.round("w", 2).alias("w"), F.round("s", 2).alias("s"))


@query(
    "one_point_per_name",
    f"SELECT name, min(fid) AS fid, min(category) AS category, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon FROM ({GEO_RIGHT}) t GROUP BY 1",
)
def one_point_per_name(spark, sf):
    out = T.one_point_per_name(shaped(spark, sf, GEO_RIGHT), "name", "fid", "category", "lat", "lon")
    return out.select("name", "fid", "category", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


_TYPES = ["signup", "purchase", "error", "view", "click"]


@query(
    "sum_pivot",
    f"SELECT postcode, period, {', '.join(f'''CAST(coalesce(sum(n) FILTER (division = '{d}'), 0) AS BIGINT) AS {d}''' for d in _TYPES)} FROM ({INCIDENTS}) t GROUP BY 1, 2",
)
def sum_pivot(spark, sf):
    return T.pivot_sums(shaped(spark, sf, INCIDENTS), ["postcode", "period"], "division", _TYPES, "n")


_FIRST = """SELECT user_id AS k, event_type AS measure, ts, event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events"""


@query(
    "first_value_pivot",
    f"""WITH e AS ({_FIRST}), p AS (SELECT k, CAST(ts AS DATE) AS d, {', '.join(f"min(v) FILTER (measure = '{m}') AS {m}" for m in _TYPES)} FROM e GROUP BY 1, 2)
  SELECT a.k, b.d, {', '.join(_TYPES)} FROM (SELECT DISTINCT k FROM p) a CROSS JOIN (SELECT DISTINCT d FROM p) b LEFT JOIN p ON p.k = a.k AND p.d = b.d""",
)
def first_value_pivot(spark, sf):
    e = shaped(spark, sf, _FIRST).withColumn("d", F.col("ts").cast("date"))
    wide = T.pivot_first(e, ["k", "d"], "measure", _TYPES, "v")
    return T.key_period_grid(wide, "k", "d").join(wide, ["k", "d"], "left")


_PLACES = "SELECT DISTINCT postcode, name_key, postcode % 6 AS area, CASE WHEN postcode % 6 = 5 THEN NULL ELSE 500e0 + postcode % 6 END AS population FROM ({i}) q"


def _rate_sql():
    per = ", ".join(f"round(1000 * {d} / population, 6) AS crime_suburb_{d}_rate_per_1k" for d in _TYPES)
    return f"""WITH i AS ({INCIDENTS}), pl AS ({_PLACES.format(i='SELECT * FROM i')}),
  w AS (SELECT area, period, {', '.join(f"CAST(coalesce(sum(n) FILTER (division = '{d}'), 0) AS BIGINT) AS {d}" for d in _TYPES)}
    FROM i JOIN pl USING (postcode, name_key) GROUP BY 1, 2),
  g AS (SELECT a.area, b.period, {', '.join(f'coalesce({d}, 0) AS {d}' for d in _TYPES)} FROM (SELECT DISTINCT area FROM w) a CROSS JOIN (SELECT DISTINCT period FROM w) b
    LEFT JOIN w ON w.area = a.area AND w.period = b.period),
  r AS (SELECT g.*, {' + '.join(_TYPES)} AS total, p.population FROM g LEFT JOIN (SELECT area, max(population) AS population FROM pl GROUP BY 1) p ON g.area = p.area),
  q AS (SELECT *, 1000 * (total / population) AS rate FROM r)
  SELECT area, period, total AS crime_suburb_incidents, population, round(rate, 6) AS crime_suburb_rate_per_1k,
    round(100 * (rate / nullif(lag(rate, 1) OVER w1, 0) - 1), 6) AS crime_suburb_rate_yoy_pct,
    round(100 * (rate / nullif(lag(rate, 3) OVER w1, 0) - 1), 6) AS crime_suburb_rate_3yr_change_pct, {per}
  FROM q WINDOW w1 AS (PARTITION BY area ORDER BY period)"""


@query("incident_rates", _rate_sql())
def incident_rates_query(spark, sf):
    i = shaped(spark, sf, INCIDENTS)
    places = i.select("postcode", "name_key").distinct().withColumns(
        {"area": F.col("postcode") % 6,
         "population": F.when(F.col("postcode") % 6 != 5, (F.col("postcode") % 6 + 500).cast("double"))}
    )
    out = incident_rates(i, places, ["postcode", "name_key"], "area", "population", _TYPES, "period", "n")
    fixed_cols = ("area", "period", "crime_suburb_incidents", "population")
    return out.select(*fixed_cols, *[r6(c, c) for c in out.columns if c not in fixed_cols])


@query(
    "monthly_means",
    """SELECT o_custkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice), 6) AS v
  FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1, 2""",
)
def monthly_means(spark, sf):
    d = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"),
    )
    return T.month_means(d, "k", "d", "v").select("k", "month", r6("v", "v"))


@query(
    "last_values",
    """SELECT user_id AS k, max_by(value, (ts, event_id)) FILTER (event_id % 4 <> 0) AS v, max_by(event_type, (ts, event_id)) FILTER (event_id % 3 <> 0) AS t
  FROM events GROUP BY 1""",
)
def last_values(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("k"), "ts", "event_id",
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("t"),
    )
    return T.last_values(e, "k", ["ts", "event_id"], ["v", "t"])


@query(
    "group_totals",
    "SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
)
def group_totals(spark, sf):
    sums = T.sum_by(table(spark, sf, "lineitem"), ["l_suppkey"], {"l_quantity": "quantity"})
    return sums.select("l_suppkey", F.round("quantity", 2).alias("quantity"))


@query(
    "column_profile",
    """SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS distinct_values, min(p_brand) AS min_value, max(p_brand) AS max_value FROM part
  UNION ALL SELECT 'p_size', count(DISTINCT p_size), CAST(min(p_size) AS VARCHAR), CAST(max(p_size) AS VARCHAR) FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type), min(p_type), max(p_type) FROM part""",
)
def column_profile(spark, sf):
    return T.column_profile(table(spark, sf, "part"), ["p_brand", "p_size", "p_type"])


_NUMBERS = """SELECT o_orderkey AS id, o_custkey AS c, o_totalprice AS p, CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_custkey % 50 + o_orderkey % 3 END AS d,
  o_totalprice * 2 + o_orderkey % 1000 * 100 AS p2, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS t FROM orders"""
_COLS = ["c", "p", "d", "p2", "t"]
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1:]]


@query(
    "pearson_matrix",
    f"WITH n AS ({_NUMBERS}) " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 8) AS r FROM n" for a, b in _PAIRS
    ),
)
def pearson_matrix(spark, sf):
    out = pearson_pairs(shaped(spark, sf, _NUMBERS), _COLS)
    return out.select("a", "b", F.round("r", 8).alias("r"))


# 120 columns with gaps of their own: the shape that column selection works on.
_WIDE_COLS = [f"w{i:03d}" for i in range(120)]
_WIDE = "SELECT " + ", ".join(
    f"CASE WHEN (o_orderkey + {i}) % {5 + i % 7} = 0 THEN NULL ELSE (o_custkey * {i % 9 + 1} + o_orderkey * {i + 1}) % {97 + 4 * i} + o_totalprice / {1000 + 500 * i} END AS {c}"
    for i, c in enumerate(_WIDE_COLS)
) + " FROM orders"


@query(
    "wide_pearson_matrix",
    f"WITH n AS ({_WIDE}), c AS (SELECT "
    + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for i, a in enumerate(_WIDE_COLS) for b in _WIDE_COLS[i + 1 :])
    + " FROM n) SELECT name[1:4] AS a, name[6:9] AS b, round(abs(r), 8) AS r FROM (UNPIVOT c ON * INTO NAME name VALUE r)",
)
def wide_pearson_matrix(spark, sf):
    out = pearson_pairs(shaped(spark, sf, _WIDE), _WIDE_COLS)
    return out.select("a", "b", F.round("r", 8).alias("r"))


def _spearman_sql():
    parts = [
        f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 8) AS r FROM (
    SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra,
      rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM n WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t"""
        for a, b in _PAIRS
    ]
    return f"WITH n AS ({_NUMBERS}) " + " UNION ALL ".join(parts)


@query("spearman_matrix", _spearman_sql())
def spearman_matrix(spark, sf):
    out = spearman_pairs(shaped(spark, sf, _NUMBERS), _COLS, "id")
    return out.select("a", "b", F.round("r", 8).alias("r"))


# Sixty columns with ties and with gaps of their own.
_RANKED = [f"w{i:02d}" for i in range(60)]
_TIED = "SELECT p_partkey AS id, " + ", ".join(
    f"CASE WHEN (p_partkey + {i}) % {5 + i % 7} = 0 THEN NULL ELSE (p_size * {i % 5 + 1} + p_partkey * {i + 3}) % {17 + 3 * i} END AS {c}" for i, c in enumerate(_RANKED)
) + " FROM part"


@query(
    "wide_spearman_matrix",
    f"""WITH n AS ({_TIED}), u AS (UNPIVOT n ON COLUMNS(* EXCLUDE id) INTO NAME c VALUE v),
  p AS (SELECT x.c AS a, y.c AS b, x.v AS va, y.v AS vb FROM u x JOIN u y ON x.id = y.id AND x.c < y.c),
  k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2 AS ra,
    rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2 AS rb FROM p)
  SELECT a, b, round(corr(ra, rb), 8) AS r FROM k GROUP BY a, b""",
)
def wide_spearman_matrix(spark, sf):
    # dealt to all cores while the rows are two numbers: the table is a few files, its sixty columns are much work
    part = table(spark, sf, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)
    out = spearman_pairs(spark.sql(_TIED.replace("FROM part", "FROM {part}"), part=part), _RANKED, "id")
    return out.select("a", "b", F.round("r", 8).alias("r"))


@query(
    "bounding_box",
    f"SELECT min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM ({GEO_LEFT}) t",
)
def bounding_box(spark, sf):
    return T.bounding_box(shaped(spark, sf, GEO_LEFT), "lat", "lon")
