"""
Cleaning rules for the listing table, one function per rule.

A row is dropped only for an unusable target, the wrong category, a stale date or
being an older copy; a bad attribute becomes null. The order of `RULES` is part of
the result: sentinels are voided before the target filter and attributes repaired
before copies are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.functions.numbers import ratio
from gridmere.functions.text import address_key
from gridmere.operators.tables import keep_latest_copies, no_older_than

Rule = Callable[[DataFrame], DataFrame]


def _true(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def _has(df: DataFrame, *cols: str) -> bool:
    return set(cols) <= set(df.columns)


def _void(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return df.withColumn(name, F.when(~_true(bad), F.col(name)))


def void_sentinels(df: DataFrame, target: str = fixed.TARGET, values=fixed.RENT_SENTINELS) -> DataFrame:
    return _void(df, target, F.col(target).isin(list(values)))


def _usable(
    target: str = fixed.TARGET, too_low: float = fixed.RENT_TOO_LOW, too_high: float = fixed.RENT_TOO_HIGH
) -> Column:
    return _true((F.col(target) >= too_low) & (F.col(target) < too_high))


def drop_unusable_target(df: DataFrame, target: str = fixed.TARGET, **limits: float) -> DataFrame:
    return df.where(_usable(target, **limits))


def _comparable(column: str = "property_type", values=fixed.OTHER_CATEGORIES) -> Column:
    return ~_true(F.col(column).isin(list(values)))


def drop_other_categories(
    df: DataFrame, column: str = "property_type", values=fixed.OTHER_CATEGORIES
) -> DataFrame:
    return df.where(_comparable(column, values)) if _has(df, column) else df


def void_implausible(
    df: DataFrame, bedrooms: str = "bedrooms", bathrooms: str = "bathrooms",
    carspaces: str = "carspaces",
) -> DataFrame:
    """Bedrooms first, so a voided bedroom count cannot condemn the bathrooms."""
    if _has(df, bedrooms):
        df = _void(df, bedrooms, F.col(bedrooms) > fixed.MAX_BEDROOMS)
    if _has(df, bathrooms):
        over = F.col(bathrooms) > fixed.MAX_BATHROOMS
        if _has(df, bedrooms):
            over = over & (F.col(bathrooms) > F.col(bedrooms) + fixed.BATHROOM_EXCESS)
        df = _void(df, bathrooms, over)
    if _has(df, carspaces):
        df = _void(df, carspaces, F.col(carspaces) > fixed.MAX_CARSPACES)
    return df


def _whole_dwelling(target: str = fixed.TARGET, bedrooms: str = "bedrooms") -> Column:
    each = ratio(F.col(target), F.col(bedrooms).cast("double"))
    return ~_true((F.col(bedrooms) >= fixed.ROOM_BEDROOMS_MIN) & (each < fixed.ROOM_RENT_MIN))


def drop_per_room(
    df: DataFrame, target: str = fixed.TARGET, bedrooms: str = "bedrooms"
) -> DataFrame:
    return df.where(_whole_dwelling(target, bedrooms)) if _has(df, bedrooms) else df


def drop_stale(df: DataFrame, date: str = "date_listed", days: int = fixed.MAX_AGE_DAYS) -> DataFrame:
    return no_older_than(df, date, days) if _has(df, date) else df


def drop_older_copies(
    df: DataFrame, address: str = "address", key=tuple(fixed.DUPLICATE_KEY),
    date: str = "date_listed", row_id: str = "listing_id",
) -> DataFrame:
    if not _has(df, address):
        return df
    df = df.withColumn("address_key", address_key(F.col(address)))
    no_address = F.col("address_key").isNull() | (F.col("address_key") == "")
    present = [c for c in key if c in df.columns]
    return keep_latest_copies(df, present, date if _has(df, date) else None, row_id, no_address)


def void_far_coordinates(
    df: DataFrame, lat: str = "lat", lon: str = "lon",
    lat_range=fixed.LAT_RANGE, lon_range=fixed.LON_RANGE,
) -> DataFrame:
    """Both are voided when either is outside; a half-missing pair is left alone."""
    if not _has(df, lat, lon):
        return df
    inside = F.col(lat).between(*lat_range) & F.col(lon).between(*lon_range)
    outside = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~inside
    return df.withColumns(
        {c: F.when(~outside, F.col(c)) for c in (lat, lon)}
    )


def fill_zeros(df: DataFrame, columns=tuple(fixed.FILL_ZERO)) -> DataFrame:
    for c in columns:
        if _has(df, c):
            df = df.withColumns(
                {f"{c}_missing": F.col(c).isNull().cast("int"),
                 c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))}
            )
    return df


def add_missing_flags(df: DataFrame, columns=tuple(fixed.MISSING_INDICATORS)) -> DataFrame:
    new = [c for c in columns if _has(df, c) and not _has(df, f"{c}_missing")]
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in new}) if new else df


def flag_high_target(
    df: DataFrame, target: str = fixed.TARGET, above: float = fixed.RENT_FLAG_HIGH,
    name: str = "rent_outlier_high",
) -> DataFrame:
    return df.withColumn(name, _true(F.col(target) > above).cast("int"))


def keep_target_range(
    df: DataFrame, target: str = fixed.TARGET, low: float = fixed.RENT_RANGE_MODELS[0],
    high: float = fixed.RENT_RANGE_MODELS[1],
) -> DataFrame:
    """The simpler filter of the model comparison."""
    return df.where(F.col(target).between(low, high))


RULES: dict[str, Rule] = {
    "sentinel_to_null": void_sentinels,
    "unusable_target": drop_unusable_target,
    "other_category": drop_other_categories,
    "implausible_to_null": void_implausible,
    "per_room_pricing": drop_per_room,
    "stale": drop_stale,
    "older_copy": drop_older_copies,
    "far_coordinates_to_null": void_far_coordinates,
    "zero_fill": fill_zeros,
    "missing_flags": add_missing_flags,
    "high_target_flag": flag_high_target,
}


def clean_listings(df: DataFrame, drop_per_room_pricing: bool = True) -> DataFrame:
    """Every rule in order."""
    if fixed.TARGET not in df.columns:
        raise KeyError(f"{fixed.TARGET!r} is not a column of the input")
    for name, rule in RULES.items():
        if name != "per_room_pricing" or drop_per_room_pricing:
            df = rule(df)
    return df


def cleaning_ledger(df: DataFrame, drop_per_room_pricing: bool = True) -> DataFrame:
    """
    Rows in and out of each dropping rule. Each row is marked with the first rule that
    drops it, so one pass counts them all; the newest date and the copies that remain are
    one pass each.
    """
    rows = void_implausible(void_sentinels(df))
    why = F.when(~_usable(), "unusable_target")
    if _has(df, "property_type"):
        why = why.when(~_comparable(), "other_category")
    if drop_per_room_pricing and _has(df, "bedrooms"):
        why = why.when(~_whole_dwelling(), "per_room_pricing")
    rows = rows.withColumn("__why", why)
    kept = rows.where(F.col("__why").isNull())
    if _has(df, "date_listed"):
        newest = kept.agg(F.max("date_listed").alias("m")).scalar()
        stale = _true(F.date_diff(newest, F.col("date_listed")) > fixed.MAX_AGE_DAYS)
        rows = rows.withColumn("__why", F.coalesce("__why", F.when(stale, "stale")))
        kept = rows.where(F.col("__why").isNull())
    left = drop_older_copies(kept).agg(F.count(F.lit(1)).alias("n")).scalar()

    names = ["unusable_target", "other_category", "per_room_pricing", "stale"]
    if not drop_per_room_pricing:
        names.remove("per_room_pricing")
    counts = rows.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count(F.when(F.col("__why") == n, 1)).alias(n) for n in names]
    ).withColumn("__left", left)
    inn, steps = F.col("__n"), []
    for i, n in enumerate([*names, "older_copy"]):
        out = F.col("__left") if n == "older_copy" else inn - F.col(n)
        steps.append(
            F.struct(
                F.lit(i).alias("step"), F.lit(n).alias("rule"), inn.alias("rows_in"), out.alias("rows_out"),
                (inn - out).alias("dropped"),
            )
        )
        inn = out
    return counts.select(F.inline(F.array(*steps)))
