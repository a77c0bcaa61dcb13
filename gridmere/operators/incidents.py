"""Incident counts by place and period to rates per 1,000 residents with their changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmere.functions.numbers import per_thousand
from gridmere.operators.tables import (
    densify, distinct_on, pivot_sums, with_lag_changes,
)


def incident_rates(
    incidents: DataFrame,
    places: DataFrame,
    place_keys: list[str],
    area: str,
    population: str,
    divisions: Sequence[str],
    period: str = "period_end",
    count: str = "incidents",
    prefix: str = "crime_suburb",
) -> DataFrame:
    """
    Counts are summed onto the area, not kept per postcode, since the population is
    that of the whole area. Every area appears in every period, so lag 1 and lag 3
    are the one- and three-period changes.
    """
    located = incidents.join(places.select(*place_keys, area), place_keys, "inner")
    wide = pivot_sums(located, [area, period], "division", divisions, count)
    dense = densify(wide, area, period, divisions)
    total = sum((F.col(d) for d in divisions[1:]), F.col(divisions[0]))
    people = distinct_on(
        places.select(area, population), [area], [F.col(population).desc_nulls_last()]
    )
    rates = (
        dense.withColumn(f"{prefix}_incidents", total)
        .join(people, area, "left")
        .withColumn(
            f"{prefix}_rate_per_1k",
            per_thousand(F.col(f"{prefix}_incidents"), F.col(population)),
        )
    )
    changed = with_lag_changes(
        rates, area, period, f"{prefix}_rate_per_1k",
        {f"{prefix}_rate_yoy_pct": 1, f"{prefix}_rate_3yr_change_pct": 3},
    )
    return changed.select(
        area, period, f"{prefix}_incidents", population, f"{prefix}_rate_per_1k",
        f"{prefix}_rate_yoy_pct", f"{prefix}_rate_3yr_change_pct",
        *[
            per_thousand(F.col(d), F.col(population)).alias(f"{prefix}_{d}_rate_per_1k")
            for d in divisions
        ],
    )
