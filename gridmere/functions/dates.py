"""Dates from labels and text. All time use is by day."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmere.functions.text import lookup

MONTHS = {name.lower(): str(i) for i, name in enumerate(calendar.month_name) if name}


def to_day(c: Column) -> Column:
    """Text (or any date type) to a date, null when it does not parse."""
    return c.try_cast("date")


def period_close(year: Column, month_name: Column) -> Column:
    """(2025, 'March') to the last day of that month, null when either is bad."""
    m = lookup(F.lower(F.trim(month_name)), MONTHS)
    y = F.lpad(year.try_cast("double").cast("int").cast("string"), 4, "0")
    first = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lit("01"))
    return F.when(y.isNotNull() & m.isNotNull(), F.last_day(first.try_cast("date")))


def fiscal_year_end(label: Column) -> Column:
    """'2022-23' to 2023."""
    return F.substring(label, 1, 4).try_cast("int") + 1


def month_or_sentinel(d: Column, sentinel: int = -1) -> Column:
    return F.coalesce(F.month(d), F.lit(sentinel))


def month_floor(d: Column) -> Column:
    return F.trunc(d, "MM").cast("date")


def years_before(d: Column, years: int) -> Column:
    return F.add_months(d, -12 * years)
