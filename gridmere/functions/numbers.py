"""Numbers that never raise: failures and impossible divisions become null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmere.functions.text import lookup


def finite(c: Column) -> Column:
    """NaN and both infinities to null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column) -> Column:
    """A decimal number in text; Java's suffixes, as in 5d or 7f, do not make one."""
    text = c.cast("string")
    return finite(F.when(text.rlike(_DECIMAL), F.trim(text)).try_cast("double"))


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("double"))


def number_or_null_zero(c: Column) -> Column:
    return zero_to_null(to_number(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(a, F.nullif(b, F.lit(0).cast("double")))


def share_pct(part: Column, total: Column) -> Column:
    return 100 * ratio(part, total)


def per_thousand(count: Column, population: Column) -> Column:
    return 1000 * ratio(count, population)


def ratio_to(a: Column, b: Column) -> Column:
    """a / b where a zero on either side means missing."""
    return ratio(zero_to_null(a), b)


def growth_pct(new: Column, old: Column) -> Column:
    """100 * (new / old - 1), null when old is zero."""
    return 100 * (ratio(new, old) - 1)


def clip01(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def blend(measured: Column, modelled: Column, coverage: Column) -> Column:
    """The measured value weighted by its coverage, the model for the rest."""
    cov = clip01(coverage)
    return F.when(measured.isNotNull(), cov * measured + (1 - cov) * modelled).otherwise(modelled)


def choose_series(
    fine: Column | None,
    coarse: Column | None,
    fine_map: Mapping[str, str],
    coarse_map: Mapping[str, str],
    default: str = "combined",
) -> Column:
    """Category to series name: the fine mapping wins over the coarse one."""
    options = []
    if fine is not None:
        options.append(lookup(fine, fine_map))
    if coarse is not None:
        options.append(lookup(coarse, coarse_map))
    return F.coalesce(*options, F.lit(default))


def column_named_by(label: Column, columns: Mapping[str, Column]) -> Column:
    """The value of the column each row names; null for any other name."""
    out = F.lit(None).cast("double")
    for name, c in columns.items():
        out = F.when(label == name, c).otherwise(out)
    return out
