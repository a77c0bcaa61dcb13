"""Growth rates from a straight line through the logarithm of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.functions.dates import years_before
from gridmere.operators.tables import month_means, not_null


def recent_months(monthly: DataFrame, month: str, years: int) -> DataFrame:
    """Months within so many years of the newest month of the whole table."""
    newest = monthly.agg(F.max(month).alias("m")).scalar()
    return monthly.where(F.col(month) >= years_before(newest, years))


def monthly_trend(
    df: DataFrame,
    key: str,
    date: str,
    value: str,
    growth: str = "rent_growth_pct",
    years: int = fixed.TREND_YEARS,
    min_months: int = fixed.TREND_MIN_MONTHS,
    min_distinct: float = fixed.TREND_MIN_DISTINCT,
    max_growth: float = fixed.TREND_MAX_GROWTH,
) -> DataFrame:
    """
    Yearly growth of the monthly mean over the last years. A key with few months, with
    mostly repeated values, or with an implausible slope has no row. R² is null for a
    flat series. The months of one key are at most 12 * years + 1.
    """
    recent = recent_months(month_means(df, key, date, value), "month", years)
    y = F.ln(value)
    t = F.date_diff("month", F.lit("1970-01-01").cast("date")) / 365.25
    fits = recent.groupBy(key).agg(
        F.regr_slope(y, t).alias("__slope"),
        F.regr_r2(y, t).alias("__r2"),
        F.min(value).alias("__lo"),
        F.max(value).alias("__hi"),
        F.count(value).alias("trend_n_months"),
        F.count_distinct(value).alias("__distinct"),
        F.max_by(value, "month").alias("current_market_rent"),
    )
    return (
        fits.where(F.col("trend_n_months") >= min_months)
        .where(F.col("__distinct") >= min_distinct * F.col("trend_n_months"))
        .withColumn(growth, (F.exp("__slope") - 1) * 100)
        .where(F.abs(growth) <= max_growth)
        .select(
            key, growth,
            F.when(F.col("__hi") > F.col("__lo"), F.col("__r2")).alias("trend_r2"),
            "trend_n_months", "current_market_rent",
        )
    )


def yearly_trend(
    df: DataFrame,
    key: str,
    year: str,
    value: str,
    name: str,
    years: int = fixed.YEARLY_TREND_YEARS,
    min_points: int = fixed.YEARLY_TREND_MIN_POINTS,
) -> DataFrame:
    """The same fit on a yearly series of positive values."""
    clean = df.where(not_null(key, year, value) & (F.col(value) > 0))
    newest = clean.agg(F.max(year).alias("m")).scalar()
    recent = clean.where(F.col(year) >= newest - years)
    return (
        recent.groupBy(key)
        .agg(
            F.regr_slope(F.ln(value), F.col(year).cast("double")).alias("__slope"),
            F.count(F.lit(1)).alias("__n"),
        )
        .where(F.col("__n") >= min_points)
        .select(key, ((F.exp("__slope") - 1) * 100).alias(name))
    )
