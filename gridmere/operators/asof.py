"""
As-of joins by key with a tolerance: latest row before, or nearest row.

How it is planned. The answer depends only on (key, time), so it is worked out
once per distinct pair and then joined back on equality:

1. both sides are reduced to distinct (key, time) in one aggregation, which
   combines before it shuffles, so copies never reach one task;
2. a window fills the last (or next) right row over those pairs. Dates give at
   most one pair per day, so a key is short. Timestamps are cut into hours: the
   window runs inside (key, hour) and a second one over one row per
   (key, hour) carries the last value across, so a hot key is spread out;
3. the left side meets the answers in a plain left equi-join. Spark broadcasts
   the answers when they are small and splits a skewed key when they are not.

The left table keeps every row, also those with a null key or time.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BACK, _AHEAD = "__back", "__ahead"


def _pairs(left, right, by, left_time, right_time, payload) -> DataFrame:
    """Distinct (key, time) of both sides, with the right row when there is one."""
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    left_type = left.schema[left_time].dataType
    row = F.struct(F.col(right_time).alias("__rt"), *[F.col(c) for c in payload])
    wanted = left.select(
        *keys, F.col(left_time).alias("__t"), F.lit(None).alias("__m"), F.lit(1).alias("__l")
    )
    found = right.select(
        *keys, F.col(right_time).cast(left_type).alias("__t"), row.alias("__m"),
        F.lit(0).alias("__l"),
    )
    names = [f"__k{i}" for i in range(len(by))]
    present = F.col("__t").isNotNull()
    for n in names:
        present = present & F.col(n).isNotNull()
    return (
        found.where(present)
        .unionByName(wanted.where(present))
        .groupBy(*names, "__t")
        .agg(F.max("__m").alias("__m"), F.max("__l").alias("__l"))
    )


def _fill(pairs: DataFrame, names: list[str], ahead: bool) -> DataFrame:
    """Adds the last (or, ahead, the next) right row at or before each pair's time."""
    out = _AHEAD if ahead else _BACK
    order = F.col("__t").desc() if ahead else F.col("__t").asc()
    until_now = (Window.unboundedPreceding, Window.currentRow)
    last_seen = F.last("__m", ignorenulls=True)
    if isinstance(pairs.schema["__t"].dataType, T.DateType):
        w = Window.partitionBy(*names).orderBy(order).rowsBetween(*until_now)
        return pairs.withColumn(out, last_seen.over(w))

    hour = F.struct(F.col("__t").cast("date").alias("d"), F.hour("__t").alias("h"))
    cut = pairs.withColumn("__b", hour)
    end = F.when(F.col("__m").isNotNull(), F.col("__t"))
    final = F.min_by("__m", end) if ahead else F.max_by("__m", end)
    per_hour = cut.groupBy(*names, "__b").agg(
        final.alias("__f"), F.max("__l").alias("__any")
    )
    b_order = F.col("__b").desc() if ahead else F.col("__b").asc()
    earlier = (
        Window.partitionBy(*names).orderBy(b_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Only hours with left rows need a carried value.
    carried = (
        per_hour.withColumn("__c", F.last("__f", ignorenulls=True).over(earlier))
        .where(F.col("__any") == 1)
        .select(*names, "__b", "__c")
    )
    w = Window.partitionBy(*names, "__b").orderBy(order).rowsBetween(*until_now)
    return (
        cut.join(carried, [*names, "__b"], "left")
        .withColumn(out, F.coalesce(last_seen.over(w), F.col("__c")))
        .drop("__b", "__c")
    )


def _within(gap: Column, tolerance: timedelta | None) -> Column:
    return F.lit(True) if tolerance is None else gap <= F.lit(tolerance)


def _attach(left, answers, by, left_time, right_time, payload, match, lag) -> DataFrame:
    names = [f"__k{i}" for i in range(len(by))]
    cols = [match["__rt"].alias(right_time)] + [match[c].alias(c) for c in payload]
    if lag:
        cols.append(F.extract(F.lit("DAY"), F.col("__t") - match["__rt"]).alias(lag))
    clash = set(left.columns) & {right_time, *payload, *([lag] if lag else [])}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    table = answers.select(*names, "__t", *cols)
    on = [left[k] == table[n] for k, n in zip(by, names)] + [left[left_time] == table["__t"]]
    return left.join(table, on, "left").drop(*names, "__t")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    payload: list[str],
    tolerance: timedelta | None = None,
    lag: str | None = None,
) -> DataFrame:
    """
    Each left row with the latest right row of its key at or before its time, if it
    is not older than the tolerance (a gap equal to it still counts). Of right rows
    at the same time the one with the largest payload is taken. `lag` names a
    column for the gap in whole days.
    """
    names = [f"__k{i}" for i in range(len(by))]
    filled = _fill(_pairs(left, right, by, left_time, right_time, payload), names, ahead=False)
    m = F.col(_BACK)
    answers = filled.where(
        (F.col("__l") == 1) & m.isNotNull() & _within(F.col("__t") - m["__rt"], tolerance)
    )
    return _attach(left, answers, by, left_time, right_time, payload, m, lag)


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    payload: list[str],
    tolerance: timedelta | None = None,
    lag: str | None = None,
) -> DataFrame:
    """As `asof_backward`, but the nearest row on either side; a tie goes to the earlier."""
    names = [f"__k{i}" for i in range(len(by))]
    pairs = _pairs(left, right, by, left_time, right_time, payload)
    filled = _fill(_fill(pairs, names, ahead=False), names, ahead=True)
    b, a = F.col(_BACK), F.col(_AHEAD)
    back_gap, ahead_gap = F.col("__t") - b["__rt"], a["__rt"] - F.col("__t")
    use_back = a.isNull() | (b.isNotNull() & (back_gap <= ahead_gap))
    near = filled.withColumn("__n", F.when(use_back, b).otherwise(a))
    n = F.col("__n")
    gap = F.greatest(F.col("__t") - n["__rt"], n["__rt"] - F.col("__t"))
    answers = near.where((F.col("__l") == 1) & n.isNotNull() & _within(gap, tolerance))
    return _attach(left, answers, by, left_time, right_time, payload, n, lag)


def year_on_year(
    series: DataFrame,
    by: list[str],
    time: str,
    values: list[str],
    lag_days: int,
    tolerance: timedelta,
) -> DataFrame:
    """
    Percent change of each value against the row nearest to `lag_days` earlier. The
    match is by date, not by row position, since thin series skip whole months.
    """
    from gridmere.functions.numbers import growth_pct

    earlier = series.select(
        *by,
        F.date_add(time, lag_days).alias("__shifted"),
        *[F.col(v).alias(f"{v}__prev") for v in values],
    )
    prev = [f"{v}__prev" for v in values]
    joined = asof_nearest(series, earlier, by, time, "__shifted", prev, tolerance)
    return joined.select(
        *series.columns,
        *[growth_pct(F.col(v), F.col(f"{v}__prev")).alias(f"{v}_yoy_pct") for v in values],
    )
