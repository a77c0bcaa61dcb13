"""Equi-joins, one-row-per-key choices, windows, sets and reports (J, W, X, T)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridmere.catalog.registry import (
    BRIDGE, CLEAN_IN, INCIDENTS, WEEKLY_INDEX, YEARLY, query, r6, shaped, table,
)
from gridmere.functions.text import address_key, place_key
from gridmere.operators import tables as T
from gridmere.operators.trend import recent_months


def nations(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")


def customers_by_nation(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


def suppliers_by_nation(spark, sf):
    # shifted, so that some nations have none and some keys no nation
    return table(spark, sf, "supplier").groupBy((F.col("s_nationkey") + 5).alias("k")).agg(
        F.count(F.lit(1)).alias("suppliers")
    )


_BY_NATION = """WITH c AS (SELECT c_nationkey AS k, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1),
  s AS (SELECT s_nationkey + 5 AS k, count(*) AS suppliers FROM supplier GROUP BY 1)"""


@query(
    "snapshot_joins",
    f"""{_BY_NATION} SELECT n_nationkey AS k, n_name, customers, balance, suppliers FROM nation
  LEFT JOIN c ON n_nationkey = c.k LEFT JOIN s ON n_nationkey = s.k""",
)
def snapshot_joins(spark, sf):
    return T.left_join_all(
        nations(spark, sf), [customers_by_nation(spark, sf), suppliers_by_nation(spark, sf)], "k"
    )


@query(
    "facts_with_area",
    f"""{_BY_NATION} SELECT c_custkey, c_nationkey AS k, c_acctbal AS balance, c.balance AS balance_area, customers
  FROM customer LEFT JOIN c ON c_nationkey = c.k""",
)
def facts_with_area(spark, sf):
    facts = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("balance")
    )
    return T.join_area_table(facts, customers_by_nation(spark, sf), "k", suffix="_area")


@query(
    "composite_key_join",
    """WITH l AS (SELECT p_name AS name_key, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE concat(p_brand, '?') END AS brand, min(p_partkey) AS code FROM part GROUP BY 1, 2)
  SELECT p_partkey, upper(p_name) AS name_key, p_brand AS brand, l.code FROM part LEFT JOIN l ON p_name = l.name_key AND p_brand = l.brand""",
)
def composite_key_join(spark, sf):
    part = table(spark, sf, "part")
    named = part.select("p_partkey", place_key(F.col("p_name")).alias("name_key"), F.col("p_brand").alias("brand"))
    other = F.concat(F.col("p_brand"), F.lit("?"))  # a brand that no part has
    codes = part.select(
        place_key(F.concat(F.col("p_name"), F.lit(" (Vic.)"))).alias("name_key"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(other).alias("brand"), F.col("p_partkey").alias("code"),
    )
    joined = T.join_unique(named, codes, ["name_key", "brand"], [F.col("code")])
    return joined.select("p_partkey", "name_key", "brand", "code")


_PLACES = """SELECT s_suppkey AS sal_code, s_nationkey % 7 AS name_key, s_nationkey % 3 AS hint,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS population FROM supplier"""


@query(
    "candidate_resolution",
    f"""WITH i AS ({INCIDENTS}), d AS (SELECT postcode, name_key, parent, row_number() OVER (PARTITION BY postcode, name_key ORDER BY sum(n) DESC, parent DESC) AS rn
    FROM i GROUP BY postcode, name_key, parent), p AS ({_PLACES}),
  c AS (SELECT d.postcode, d.name_key, p.sal_code, p.population, CAST(p.hint = d.parent AS INT) AS h,
     count(*) OVER (PARTITION BY d.postcode, d.name_key) AS n FROM d JOIN p ON d.name_key = p.name_key WHERE d.rn = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY postcode, name_key ORDER BY h DESC, population DESC NULLS LAST, sal_code) AS rn FROM c)
  SELECT postcode, name_key, sal_code, population, CAST(n > 1 AND h = 0 AS INT) AS ambiguous FROM r WHERE rn = 1""",
)
def candidate_resolution(spark, sf):
    wanted = T.dominant_child(shaped(spark, sf, INCIDENTS), ["postcode", "name_key"], "parent", "n")
    out = T.resolve_candidates(
        wanted, shaped(spark, sf, _PLACES), "name_key", ["postcode", "name_key"], ("hint", "parent"),
        "population", "sal_code", "ambiguous",
    )
    return out.select("postcode", "name_key", "sal_code", "population", "ambiguous")


@query(
    "yearly_full_outer",
    f"""WITH a AS ({YEARLY}), b AS (SELECT s_nationkey AS k, CAST(year(l_shipdate) AS INT) AS yr, count(*) AS shipped FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY 1, 2), c AS (SELECT k + 5 AS k, yr, v FROM a)
  SELECT coalesce(c.k, b.k) AS k, coalesce(c.yr, b.yr) AS yr, v, shipped FROM c FULL JOIN b ON c.k = b.k AND c.yr = b.yr""",
)
def yearly_full_outer(spark, sf):
    a = shaped(spark, sf, YEARLY).withColumn("k", F.col("k") + 5)
    b = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("k"), F.year("l_shipdate").alias("yr"))
        .agg(F.count(F.lit(1)).alias("shipped"))
    )
    return T.full_join_all([a, b], ["k", "yr"])


@query(
    "chained_left_joins",
    """SELECT o_orderkey AS k, o_orderstatus, i.n_items, i.qty, r.returned FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1) i ON o_orderkey = i.l_orderkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON o_orderkey = r.l_orderkey""",
)
def chained_left_joins(spark, sf):
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    counts = items.groupBy("k").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    returned = items.where(F.col("l_returnflag") == "R").groupBy("k").agg(F.count(F.lit(1)).alias("returned"))
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return T.left_join_all(base, [counts, returned], "k")


@query(
    "area_attribute_join",
    """WITH a AS (SELECT CAST(s_nationkey AS VARCHAR) AS code, round(avg(s_acctbal), 6) AS income FROM supplier GROUP BY 1)
  SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name, income FROM nation LEFT JOIN a ON CAST(n_nationkey AS VARCHAR) = a.code""",
)
def area_attribute_join(spark, sf):
    from gridmere.functions.text import code_key_everywhere

    areas = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    code = code_key_everywhere(F.concat(F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(".0")))
    income = table(spark, sf, "supplier").groupBy(code.alias("code")).agg(r6(F.avg("s_acctbal"), "income"))
    return areas.join(income, "code", "left")


@query(
    "dense_panel",
    f"""WITH i AS ({INCIDENTS}), w AS (SELECT postcode, period, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY 1, 2)
  SELECT a.postcode, b.period, coalesce(w.n, 0) AS n FROM (SELECT DISTINCT postcode FROM w) a CROSS JOIN (SELECT DISTINCT period FROM w) b
  LEFT JOIN w ON w.postcode = a.postcode AND w.period = b.period""",
)
def dense_panel(spark, sf):
    sums = shaped(spark, sf, INCIDENTS).groupBy("postcode", "period").agg(F.sum("n").alias("n"))
    return T.densify(sums, "postcode", "period", ["n"])


@query(
    "key_period_grid",
    """SELECT k, y FROM (SELECT DISTINCT o_custkey AS k FROM orders) a CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders) b""",
)
def key_period_grid(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    return T.key_period_grid(d, "k", "y")


@query(
    "semi_join_count",
    """SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS matched, (SELECT count(*) FROM customer) AS total""",
)
def semi_join_count(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return T.matched_keys(base, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(
    "union_by_name",
    """SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier
  UNION ALL SELECT o_custkey, NULL, o_orderpriority FROM orders""",
)
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k"))
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("seg"), F.col("o_custkey").alias("k"))
    return T.union_all([c, s, o])


@query(
    "distinct_on_subset",
    """SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""",
)
def distinct_on_subset(spark, sf):
    return T.distinct_on(
        table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"],
        [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()],
    )


@query(
    "exclude_keys",
    """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (3, 7)
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)""",
)
def exclude_keys(spark, sf):
    kept = T.exclude_listed(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", [3, 7])
    urgent = table(spark, sf, "orders").where(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)
    )
    return T.exclude_keys(kept, urgent.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


# --- windows ----------------------------------------------------------------


@query(
    "share_of_total",
    f"""WITH b AS ({BRIDGE}) SELECT area_a, area_b, area_c,
  round(coalesce(w / nullif(sum(w) OVER (PARTITION BY area_b), 0), area_size / nullif(sum(area_size) OVER (PARTITION BY area_b), 0)), 8) AS share_of_b,
  round(coalesce(w / nullif(sum(w) OVER (PARTITION BY area_a), 0), area_size / nullif(sum(area_size) OVER (PARTITION BY area_a), 0)), 8) AS share_of_a FROM b""",
)
def share_of_total(spark, sf):
    shares = T.with_shares(
        shaped(spark, sf, BRIDGE), {"area_b": "share_of_b", "area_a": "share_of_a"}, "w", "area_size"
    )
    return shares.select(
        "area_a", "area_b", "area_c", *[F.round(c, 8).alias(c) for c in ("share_of_b", "share_of_a")]
    )


@query(
    "group_size",
    "SELECT l_orderkey, l_linenumber, l_suppkey, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem",
)
def group_size(spark, sf):
    return T.with_group_size(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), ["l_suppkey"], "n"
    )


@query(
    "lag_changes",
    f"""WITH g AS (SELECT n_nationkey AS k, CAST(y AS INT) AS yr FROM nation, (SELECT unnest(range(1995, 2002)) AS y) t), d AS (SELECT g.k, g.yr, coalesce(q.v, 0) AS v FROM g LEFT JOIN ({YEARLY}) q ON g.k = q.k AND g.yr = q.yr)
  SELECT k, yr, v, round(100 * (v / nullif(lag(v, 1) OVER w, 0) - 1), 6) AS yoy, round(100 * (v / nullif(lag(v, 3) OVER w, 0) - 1), 6) AS three
  FROM d WINDOW w AS (PARTITION BY k ORDER BY yr)""",
)
def lag_changes(spark, sf):
    dense = T.densify(shaped(spark, sf, YEARLY), "k", "yr", ["v"])
    out = T.with_lag_changes(dense, "k", "yr", "v", {"yoy": 1, "three": 3})
    return out.select("k", "yr", "v", r6("yoy", "yoy"), r6("three", "three"))


@query(
    "padded_change",
    f"""WITH s AS (SELECT k, week, nullif(v, 0) AS v FROM ({WEEKLY_INDEX}) t),
  f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM s)
  SELECT k, week, round(100 * (p / lag(p) OVER (PARTITION BY k ORDER BY week) - 1), 6) AS change FROM f""",
)
def padded_change(spark, sf):
    s = shaped(spark, sf, WEEKLY_INDEX).withColumn("v", F.nullif("v", F.lit(0.0)))
    return T.with_padded_change(s, "k", "week", "v", "change").select("k", "week", r6("change", "change"))


@query(
    "preferred_row",
    """SELECT p_name, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size DESC, p_retailprice DESC NULLS LAST, p_partkey) AS rn FROM part) t WHERE rn = 1""",
)
def preferred_row(spark, sf):
    return T.keep_first(
        table(spark, sf, "part").select("p_name", "p_brand", "p_partkey", "p_size", "p_retailprice"),
        ["p_name", "p_brand"],
        [F.col("p_size").desc(), F.col("p_retailprice").desc_nulls_last(), F.col("p_partkey")],
    ).select("p_name", "p_brand", "p_partkey")


@query(
    "dominant_child",
    f"""WITH i AS ({INCIDENTS}), s AS (SELECT postcode, division, CAST(sum(n) AS BIGINT) AS t FROM i GROUP BY 1, 2)
  SELECT postcode, max_by(division, (t, division)) AS division FROM s GROUP BY 1""",
)
def dominant_child(spark, sf):
    return T.dominant_child(shaped(spark, sf, INCIDENTS), ["postcode"], "division", "n")


@query(
    "keep_latest_copies",
    f"""WITH c AS (SELECT id, a1, d, trim(regexp_replace(replace(upper(address) || ' ', ' AVE ', ' AVENUE '), '[^A-Z0-9]+', ' ', 'g')) AS address_key FROM ({CLEAN_IN}) t),
  r AS (SELECT *, row_number() OVER (PARTITION BY address_key, a1 ORDER BY d DESC NULLS LAST, id DESC) AS rn FROM c)
  SELECT id, a1, d, address_key FROM r WHERE address_key IS NULL OR rn = 1""",
)
def keep_latest_copies(spark, sf):
    c = shaped(spark, sf, CLEAN_IN).select("id", "a1", "d", address_key(F.col("address")).alias("address_key"))
    return T.keep_latest_copies(c, ["address_key", "a1"], "d", "id", F.col("address_key").isNull())


@query(
    "newest_release",
    f"""WITH a AS ({YEARLY}) SELECT k, yr, CASE WHEN yr >= 1997 THEN v ELSE v + k END AS v, CASE WHEN yr >= 1997 THEN 'new' ELSE 'old' END AS release FROM a""",
)
def newest_release(spark, sf):
    y = shaped(spark, sf, YEARLY)
    new = y.where(F.col("yr") >= 1997).withColumn("release", F.lit("new"))
    old = y.withColumns({"v": F.col("v") + F.col("k"), "release": F.lit("old")})
    return T.newest_release([new, old], ["k", "yr"])


@query(
    "header_fill",
    """SELECT n_regionkey AS block, n_nationkey AS position, max(CASE WHEN n_nationkey % 4 = 0 THEN n_name END) OVER (PARTITION BY n_regionkey, g) AS label
  FROM (SELECT *, count(CASE WHEN n_nationkey % 4 = 0 THEN 1 END) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS g FROM nation) t""",
)
def header_fill(spark, sf):
    h = table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("block"), F.col("n_nationkey").alias("position"),
        F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).alias("label"),
    )
    return T.fill_forward(h, "position", "label", ["block"])


@query(
    "no_older_than",
    f"SELECT id, d FROM ({CLEAN_IN}) t WHERE d IS NULL OR date_diff('day', d, (SELECT max(d) FROM ({CLEAN_IN}) u)) <= 365",
)
def no_older_than(spark, sf):
    return T.no_older_than(shaped(spark, sf, CLEAN_IN).select("id", "d"), "d", 365)


@query(
    "recent_window",
    """WITH m AS (SELECT o_custkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice), 6) AS v FROM orders GROUP BY 1, 2)
  SELECT * FROM m WHERE month >= (SELECT max(month) FROM m) - INTERVAL 3 YEAR""",
)
def recent_window(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    return recent_months(T.month_means(d, "k", "d", "v"), "month", 3).select("k", "month", r6("v", "v"))


# --- reports ----------------------------------------------------------------


@query(
    "ordered_output",
    "SELECT k, yr, v, row_number() OVER (ORDER BY k, yr) AS line FROM (" + YEARLY + ") t",
)
def ordered_output(spark, sf):
    """The written order, shown as a line number per (small) yearly table."""
    from gridmere.session import new_path
    from gridmere.sources.tables import write_table

    path = new_path(spark, "ordered")
    write_table(shaped(spark, sf, YEARLY), path, "parquet", order_by=["k", "yr"])
    back = spark.read.parquet(path).select("k", "yr", "v")
    # Each file holds one range; a row's line is the rows before its file plus its place inside.
    at = back.withColumns({"f": F.col("_metadata.file_name"), "i": F.col("_metadata.row_index")})
    per_file = at.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    files = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    earlier = per_file.select("f", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("before"))
    return at.join(earlier, "f").select("k", "yr", "v", (F.col("before") + F.col("i") + 1).alias("line"))


@query(
    "top_areas",
    """SELECT c_nationkey AS k, round(avg(c_acctbal), 6) AS growth FROM customer GROUP BY 1 HAVING count(*) >= 20 ORDER BY 2 DESC LIMIT 10""",
)
def top_areas(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        r6(F.avg("c_acctbal"), "growth"), F.count(F.lit(1)).alias("n")
    )
    return T.top(g.where(F.col("n") >= 20), "growth", 10, "k").drop("n")


