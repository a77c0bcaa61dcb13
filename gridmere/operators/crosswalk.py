"""Moving values between area systems that do not nest, and between releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmere.functions.numbers import ratio
from gridmere.operators.tables import not_null, sum_by, with_shares


def build_correspondence(
    blocks: DataFrame,
    keys: list[str],
    measures: dict[str, str],
    shares: dict[str, str],
    weight: str,
    fallback: str,
) -> DataFrame:
    """One row per overlap of the area systems, with the share of each it makes up."""
    overlaps = sum_by(blocks, keys, measures)
    return with_shares(overlaps, shares, measures[weight], measures[fallback])


def weighted_values(
    bridge: DataFrame,
    values: DataFrame,
    target: str | list[str],
    source: str,
    share: str,
) -> DataFrame:
    """
    The weighted average of each value column over the target's sources, with weights
    renormalised over the sources that have that value. `coverage` is the covered
    share of the weight for the first value column.
    """
    targets = [target] if isinstance(target, str) else list(target)
    columns = [c for c in values.columns if c != source]
    weights = (
        bridge.where(not_null(*targets, source))
        .groupBy(*targets, F.col(source).cast("string").alias(source))
        .agg(F.sum(share).alias("__w"))
    )
    right = values.withColumn(source, F.col(source).cast("string"))
    w = F.col("__w")

    def covered(c: str):
        return F.sum(F.when(F.col(c).isNotNull(), w))

    first = columns[0]
    return (
        weights.join(right, source, "left")
        .groupBy(*targets)
        .agg(
            *[ratio(F.sum(w * F.col(c)), covered(c)).alias(c) for c in columns],
            F.coalesce(
                ratio(F.coalesce(covered(first), F.lit(0.0)), F.sum(w)), F.lit(0.0)
            ).alias("coverage"),
        )
    )


def share_sums(
    bridge: DataFrame, values: DataFrame, target: str, source: str, share: str
) -> DataFrame:
    """The plain recipe: sum(share * value), with no renormalising."""
    columns = [c for c in values.columns if c != source]
    return (
        bridge.join(values, source, "left")
        .groupBy(target)
        .agg(*[F.sum(F.col(share) * F.col(c)).alias(c) for c in columns])
    )


def rescale_release(
    older: DataFrame,
    newer: DataFrame,
    area: str,
    period: str,
    measures: Sequence[str],
    release: str,
    suffix: str = " (rescaled)",
) -> DataFrame:
    """
    An older release brought to the level of a newer one: each area's measures times
    the median newer/older ratio over the periods both cover. When no factor differs
    from 1 the release is returned as it is; otherwise every row is multiplied and
    labelled, and an area without overlap has no factor and becomes null.
    """
    new = newer.select(area, period, *[F.col(m).alias(f"__new_{m}") for m in measures])
    factors = (
        older.join(new, [area, period], "inner")
        .groupBy(area)
        .agg(
            *[F.median(ratio(F.col(f"__new_{m}"), F.col(m))).alias(f"__f_{m}") for m in measures]
        )
    )
    off = F.greatest(
        *[F.abs(F.coalesce(F.col(f"__f_{m}"), F.lit(1.0)) - 1) for m in measures], F.lit(0.0)
    )
    # One value for the whole release: does any factor differ from 1?
    changed = factors.agg(F.coalesce(F.max(off) > 1e-9, F.lit(False)).alias("c")).scalar()
    scaled = {m: F.when(changed, F.col(m) * F.col(f"__f_{m}")).otherwise(F.col(m)) for m in measures}
    return (
        older.join(factors, area, "left")
        .withColumns(scaled)
        .withColumn(
            release,
            F.when(changed, F.concat(F.col(release), F.lit(suffix))).otherwise(F.col(release)),
        )
        .select(*older.columns)
    )
