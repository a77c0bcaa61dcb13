"""
Joins, groupings, windows and grids on keyed tables.

Two habits keep a hot key from landing in one task. A value per group is
aggregated (combined before the shuffle) and joined back on the key, instead of
a window over all rows of the group; and "one row per key" is a row number of at
most one, which Spark already limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmere.functions.numbers import finite, growth_pct, ratio


def not_null(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


# --- joins ------------------------------------------------------------------


def left_join_all(base: DataFrame, others: Iterable[DataFrame], key: str | list[str]) -> DataFrame:
    """Every table of a list left-joined onto the base on one key."""
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def join_area_table(
    facts: DataFrame, areas: DataFrame, key: str, suffix: str | None = None
) -> DataFrame:
    """
    Facts with the columns of their area. A name both sides have comes from the
    facts; the area's copy is dropped before the join, or kept under a suffix.
    """
    clash = [c for c in areas.columns if c in facts.columns and c != key]
    if suffix is None:
        areas = areas.drop(*clash)
    else:
        areas = areas.withColumnsRenamed({c: c + suffix for c in clash})
    return facts.join(areas, key, "left")


def full_join_all(tables: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), tables)


def join_unique(
    facts: DataFrame, lookup: DataFrame, keys: list[str], prefer: list[Column]
) -> DataFrame:
    """Left join on a composite key after reducing the lookup to one row per key."""
    return facts.join(keep_first(lookup.where(not_null(*keys)), keys, prefer), keys, "left")


def matched_keys(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """How many base rows have a partner: matched, total."""
    hit = other.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__hit", F.lit(1))
    return base.select(key).join(hit, key, "left").agg(
        F.count("__hit").alias("matched"), F.count(F.lit(1)).alias("total")
    )


def exclude_listed(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is not in a literal list; null is not in it."""
    return df.where(F.coalesce(~F.col(column).isin(list(values)), F.lit(True)))


def exclude_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


# --- one row per key --------------------------------------------------------


def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in a given, complete order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 1).drop("__rn")


def keep_latest_copies(
    df: DataFrame, keys: list[str], date: str | None, row_id: str, exempt: Column
) -> DataFrame:
    """
    The newest copy of each key; rows without a date are the oldest. Null key parts
    compare equal. Exempt rows are all kept: their own id joins the key.
    """
    newest = [F.col(date).desc_nulls_last()] if date else []
    own = F.when(exempt, F.col(row_id))
    marked = df.withColumn("__own", own)
    return keep_first(marked, [*keys, "__own"], [*newest, F.col(row_id).desc()]).drop("__own")


def newest_release(tables: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Releases stacked newest first; the newest one with a key wins."""
    stacked = union_all([t.withColumn("__rank", F.lit(i)) for i, t in enumerate(tables)])
    return keep_first(stacked, list(keys), [F.col("__rank")]).drop("__rank")


def dominant_child(df: DataFrame, keys: list[str], child: str, amount: str) -> DataFrame:
    """The child with the largest summed amount per key; ties go to the last name."""
    sums = df.groupBy(*keys, child).agg(F.sum(amount).alias("__sum"))
    return sums.groupBy(*keys).agg(F.max(F.struct("__sum", child))[child].alias(child))


def resolve_candidates(
    wanted: DataFrame,
    candidates: DataFrame,
    name: str,
    keys: list[str],
    hint: tuple[str, str],
    size: str,
    candidate_id: str,
    flag: str,
) -> DataFrame:
    """
    One candidate per key among all with the same name: one whose hint agrees, then
    the larger, then the lower id. Flagged where there were several and none agreed.

    The best candidate per name and hint, and the best per name, are found first, so a key
    meets two rows however many candidates share its name.
    """
    mine, theirs = hint
    named = candidates.where(F.col(name).isNotNull())
    order = [F.col(size).desc_nulls_last(), F.col(candidate_id)]
    row = F.struct(*[c for c in candidates.columns if c != name])
    agreeing = keep_first(named.where(F.col(mine).isNotNull()), [name, mine], order).select(
        name, F.col(mine).alias(theirs), row.alias("__agreed")
    )
    largest = keep_first(named, [name], order).select(name, row.alias("__largest"))
    several = named.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    unresolved = (F.col("__n") > 1) & F.col("__agreed").isNull()
    return (
        keep_first(wanted, list(keys), [F.col(theirs)])
        .join(agreeing, [name, theirs], "left")
        .join(largest.join(several, name), name, "inner")
        .withColumns({flag: unresolved.cast("int"), "__pick": F.coalesce("__agreed", "__largest")})
        .select(*wanted.columns, "__pick.*", flag)
    )


def last_values(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last non-null value of each column per key, each column by itself."""
    when = F.struct(*order)
    return df.where(not_null(key, order[0])).groupBy(key).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), when)).alias(v) for v in values]
    )


# --- a group value on every row ---------------------------------------------


def with_group_size(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")


def with_shares(
    df: DataFrame, areas: Mapping[str, str], measure: str, fallback: str
) -> DataFrame:
    """
    Each row's share of its area's total, for several area columns at once. An area
    whose total is zero is shared out by the fallback measure.
    """
    out = df
    for area, share in areas.items():
        totals = df.groupBy(area).agg(
            F.sum(measure).alias("__m"), F.sum(fallback).alias("__f")
        )
        value = F.coalesce(
            ratio(F.col(measure), F.col("__m")), ratio(F.col(fallback), F.col("__f"))
        )
        out = out.join(totals, area, "left").withColumn(share, value).drop("__m", "__f")
    return out.select(*df.columns, *areas.values())


def no_older_than(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows at most this many days older than the newest date; undated rows stay."""
    newest = df.agg(F.max(date).alias("m")).scalar()
    return df.where(F.coalesce(F.date_diff(newest, F.col(date)) <= days, F.lit(True)))


# --- ordered series, one row per key and period -----------------------------


def with_lag_changes(
    df: DataFrame, key: str, period: str, value: str, lags: Mapping[str, int]
) -> DataFrame:
    """Percent change against earlier rows of a dense series; infinite becomes null."""
    w = Window.partitionBy(key).orderBy(period)
    return df.select(
        "*", *[growth_pct(F.col(value), F.lag(value, n).over(w)).alias(c) for c, n in lags.items()]
    )


def with_padded_change(df: DataFrame, key: str, period: str, value: str, name: str) -> DataFrame:
    """Percent change against the previous row after filling gaps forward."""
    w = Window.partitionBy(key).orderBy(period)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = df.withColumn("__v", F.last(value, ignorenulls=True).over(so_far))
    change = growth_pct(F.col("__v"), F.lag("__v").over(w))
    return filled.withColumn(name, change).drop("__v")


def fill_forward(df: DataFrame, position: str, label: str, block: list[str]) -> DataFrame:
    """A label written once, above its block of columns, repeated across the block."""
    w = Window.partitionBy(*block).orderBy(position)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(label, F.last(label, ignorenulls=True).over(so_far))


# --- groupings --------------------------------------------------------------


def sum_by(df: DataFrame, keys: list[str], measures: Mapping[str, str]) -> DataFrame:
    """Sums per key; rows with a null key part are left out."""
    return df.where(not_null(*keys)).groupBy(*keys).agg(
        *[F.sum(m).alias(out) for m, out in measures.items()]
    )


def one_point_per_name(
    df: DataFrame, name: str, first_id: str, least: str, lat: str, lon: str
) -> DataFrame:
    """Records collapsed to their mean position; lowest id and lowest category kept."""
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(
        F.min(first_id).alias(first_id),
        F.min(least).alias(least),
        F.avg(lat).alias(lat),
        F.avg(lon).alias(lon),
    )


def pivot_sums(
    df: DataFrame, keys: list[str], column: str, values: Sequence[str], measure: str
) -> DataFrame:
    """One summed column per listed value, zero where there is none."""
    return df.where(not_null(*keys, column)).groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(column) == v, F.col(measure))), F.lit(0)).alias(v)
            for v in values
        ]
    )


def pivot_first(
    df: DataFrame, keys: list[str], column: str, values: Sequence[str], value: str
) -> DataFrame:
    """One column per listed value holding its (lowest) value, null where there is none."""
    return df.where(not_null(*keys)).groupBy(*keys).agg(
        *[F.min(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values]
    )


def month_means(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Mean per key and month over the rows that have a value."""
    return (
        df.where(not_null(key, date, value))
        .groupBy(key, F.trunc(date, "MM").alias("month"))
        .agg(F.avg(value).alias(value))
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct count, minimum and maximum of each column, one row per column, from one scan."""
    one = df.agg(
        *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)],
        *[F.min(c).cast("string").alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("string").alias(f"z{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_values"),
                F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.inline(rows))


def bounding_box(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(
        F.min(lat).alias("south"), F.max(lat).alias("north"),
        F.min(lon).alias("west"), F.max(lon).alias("east"),
    )


# --- sets and grids ---------------------------------------------------------


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def key_period_grid(df: DataFrame, key: str, period: str) -> DataFrame:
    """
    Every key in every period. Periods are calendar steps, so they fit an array;
    each distinct key explodes that array. Distinct periods are found by a grouping, so
    that only they meet in one place.
    """
    periods = (
        df.select(period).where(F.col(period).isNotNull()).distinct()
        .agg(F.array_sort(F.collect_list(period)).alias("p")).scalar()
    )
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.select(key, F.explode(periods).alias(period))


def densify(df: DataFrame, key: str, period: str, zero: Sequence[str]) -> DataFrame:
    """The grid with its facts, zero where a period has none."""
    return (
        key_period_grid(df, key, period)
        .join(df, [key, period], "left")
        .fillna(0, subset=list(zero))
    )


def distinct_on(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key: by a stated order where the other columns differ."""
    return keep_first(df, list(keys), order) if order else df.dropDuplicates(keys)


def top(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n largest rows, as a report."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie)).limit(n)


def finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})
