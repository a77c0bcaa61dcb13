"""As-of joins."""

from datetime import timedelta

from pyspark.sql import functions as F

from gridmere.catalog.registry import (
    ASOF_LEFT, ASOF_RIGHT, INCIDENTS, WEEKLY_INDEX, query, r6, shaped, table,
)
from gridmere.operators.asof import asof_backward, asof_nearest, year_on_year
from gridmere.functions.numbers import zero_to_null

_ASOF = f"""WITH l AS ({ASOF_LEFT}), r AS ({ASOF_RIGHT}),
  r1 AS (SELECT k, rts, max(v) AS v FROM r GROUP BY 1, 2)
  SELECT l.event_id, l.k, l.ts, {{pick}} FROM l ASOF LEFT JOIN r1 ON l.k = r1.k AND l.ts >= r1.rts"""


@query(
    "asof_backward",
    _ASOF.format(
        pick="""CASE WHEN l.ts - r1.rts <= INTERVAL 7 DAY THEN r1.rts END AS rts,
  CASE WHEN l.ts - r1.rts <= INTERVAL 7 DAY THEN r1.v END AS v,
  CASE WHEN l.ts - r1.rts <= INTERVAL 7 DAY
    THEN CAST(floor((epoch_us(l.ts) - epoch_us(r1.rts)) / 86400000000) AS INT) END AS lag_days"""
    ),
)
def asof_backward_tolerance(spark, sf):
    return asof_backward(
        shaped(spark, sf, ASOF_LEFT), shaped(spark, sf, ASOF_RIGHT), ["k"], "ts", "rts", ["v"],
        tolerance=timedelta(days=7), lag="lag_days",
    )


@query("asof_backward_unbounded", _ASOF.format(pick="r1.rts, r1.v"))
def asof_backward_unbounded(spark, sf):
    return asof_backward(
        shaped(spark, sf, ASOF_LEFT), shaped(spark, sf, ASOF_RIGHT), ["k"], "ts", "rts", ["v"]
    )


@query(
    "asof_mapped_key",
    f"""WITH l AS (SELECT event_id, user_id % 20 AS postcode, user_id % 7 AS name_key, CAST(ts AS DATE) AS day FROM events),
  i AS ({INCIDENTS}),
  pairs AS (SELECT postcode, name_key, max(parent) AS area FROM i GROUP BY 1, 2),
  r AS (SELECT area, period, CAST(sum(n) AS BIGINT) AS n FROM i JOIN pairs USING (postcode, name_key)
        WHERE i.division = 'error' GROUP BY 1, 2),
  m AS (SELECT l.*, pairs.area FROM l LEFT JOIN pairs USING (postcode, name_key))
  SELECT m.event_id, m.area,
    CASE WHEN date_diff('day', r.period, m.day) <= 3 THEN r.period END AS period,
    CASE WHEN date_diff('day', r.period, m.day) <= 3 THEN r.n END AS n
  FROM m ASOF LEFT JOIN r ON m.area = r.area AND m.day >= r.period""",
)
def asof_mapped_key(spark, sf):
    left = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 20).alias("postcode"), (F.col("user_id") % 7).alias("name_key"),
        F.col("ts").cast("date").alias("day"),
    )
    incidents = shaped(spark, sf, INCIDENTS)
    pairs = incidents.groupBy("postcode", "name_key").agg(F.max("parent").alias("area"))
    rates = (
        incidents.where(F.col("division") == "error")
        .join(pairs, ["postcode", "name_key"])
        .groupBy("area", "period")
        .agg(F.sum("n").alias("n"))
    )
    mapped = left.join(pairs, ["postcode", "name_key"], "left")
    return asof_backward(
        mapped, rates, ["area"], "day", "period", ["n"], tolerance=timedelta(days=3)
    ).select("event_id", "area", "period", "n")


@query(
    "asof_nearest",
    f"""WITH l AS ({ASOF_LEFT}), r AS ({ASOF_RIGHT}),
  r1 AS (SELECT k, rts, max(v) AS v FROM r GROUP BY 1, 2),
  b AS (SELECT l.*, r1.rts AS brts, r1.v AS bv FROM l ASOF LEFT JOIN r1 ON l.k = r1.k AND l.ts >= r1.rts),
  a AS (SELECT b.*, r1.rts AS arts, r1.v AS av FROM b ASOF LEFT JOIN r1 ON b.k = r1.k AND b.ts <= r1.rts),
  c AS (SELECT *, arts IS NULL OR (brts IS NOT NULL AND ts - brts <= arts - ts) AS back FROM a),
  d AS (SELECT event_id, k, ts, CASE WHEN back THEN brts ELSE arts END AS rts,
          CASE WHEN back THEN bv ELSE av END AS v FROM c)
  SELECT event_id, k, ts,
    CASE WHEN abs(epoch_us(ts) - epoch_us(rts)) <= 43200000000 THEN rts END AS rts,
    CASE WHEN abs(epoch_us(ts) - epoch_us(rts)) <= 43200000000 THEN v END AS v FROM d""",
)
def asof_nearest_tolerance(spark, sf):
    return asof_nearest(
        shaped(spark, sf, ASOF_LEFT), shaped(spark, sf, ASOF_RIGHT), ["k"], "ts", "rts", ["v"],
        tolerance=timedelta(hours=12),
    )


@query(
    "index_year_on_year",
    f"""WITH s AS (SELECT k, week, nullif(v, 0) AS v FROM ({WEEKLY_INDEX}) t),
  p AS (SELECT k, CAST(week + INTERVAL 364 DAY AS DATE) AS shifted, v AS prev FROM s),
  b AS (SELECT s.*, p.shifted AS bs, p.prev AS bp FROM s ASOF LEFT JOIN p ON s.k = p.k AND s.week >= p.shifted),
  a AS (SELECT b.*, p.shifted AS sa, p.prev AS ap FROM b ASOF LEFT JOIN p ON b.k = p.k AND b.week <= p.shifted),
  c AS (SELECT *, sa IS NULL OR (bs IS NOT NULL AND week - bs <= sa - week) AS back FROM a),
  d AS (SELECT k, week, v, CASE WHEN back THEN bs ELSE sa END AS shifted, CASE WHEN back THEN bp ELSE ap END AS prev FROM c)
  SELECT k, week, round(v, 6) AS v,
    round(CASE WHEN abs(week - shifted) <= 10 THEN 100 * (v / prev - 1) END, 6) AS v_yoy_pct FROM d""",
)
def index_year_on_year(spark, sf):
    series = shaped(spark, sf, WEEKLY_INDEX).withColumn("v", zero_to_null(F.col("v")))
    out = year_on_year(series, ["k"], "week", ["v"], 364, timedelta(days=10))
    return out.select("k", "week", r6("v", "v"), r6("v_yoy_pct", "v_yoy_pct"))
