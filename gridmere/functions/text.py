"""Keys and labels made from text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmere import fixed


def code_key(c: Column) -> Column:
    """Area codes as text: one trailing '.0' removed, trimmed, null stays null."""
    return F.trim(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def code_key_everywhere(c: Column) -> Column:
    """The exploratory variant, which removes every '.0'."""
    return F.trim(F.replace(c.cast("string"), F.lit(".0"), F.lit("")))


def area_key(c: Column) -> Column:
    """Upper case, runs of anything but letters and digits to one space."""
    return F.trim(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]+", " "))


def place_key(c: Column) -> Column:
    """`area_key` without a trailing parenthesis."""
    return area_key(F.regexp_replace(F.trim(c), r"\s*\([^)]*\)\s*$", ""))


def name_hint(c: Column) -> Column:
    """Key of the text inside the trailing parenthesis, '' when there is none."""
    inner = F.regexp_extract(c, r"\(([^)]*)\)\s*$", 1)
    return area_key(F.regexp_replace(inner, r"\s*-\s*Vic\.?\s*$", ""))


def address_key(c: Column, words: Mapping[str, str] = fixed.STREET_WORDS) -> Column:
    """Street words spelled out, then the `area_key` form."""
    text = F.upper(F.trim(c))
    for short, full in words.items():
        text = F.regexp_replace(text, rf"\b{short}\b", full)
    return F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " "))


def station_name(c: Column, pattern: str = fixed.STATION_NAME) -> Column:
    """'X' from 'X Railway Station (Y)'; null when the name is not a station."""
    return F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit(""))


def labels_of(raw: Column) -> Column:
    """The lower-cased labels of a comma-separated list."""
    return F.transform(F.split(raw, r",\s*"), lambda t: F.lower(F.trim(t)))


def label_flags(
    labels: Column, patterns: Mapping[str, str] = fixed.LABEL_FLAGS, prefix: str = "feat_"
) -> list[Column]:
    """
    One 0/1 flag per pattern over an array of labels (`labels_of`), best a column of its own, as
    every flag looks at it. No list at all gives null, not 0.
    """

    def flag(pattern: str) -> Column:
        hit = F.exists(labels, lambda t: t.rlike(pattern))
        return F.when(labels.isNotNull(), hit.cast("int"))

    return [flag(p).alias(prefix + name) for name, p in patterns.items()]


def matches_code(c: Column, digits: int, first: str = "2") -> Column:
    """Full match on a code of one state: its first digit and `digits` more."""
    return F.coalesce(c.rlike(rf"^{first}\d{{{digits}}}$"), F.lit(False))


def is_open(status: Column, code: str = "O") -> Column:
    return F.coalesce(F.upper(status) == code, F.lit(False))


def division(c: Column, names: Mapping[str, str] = fixed.DIVISIONS) -> Column:
    """First letter of the trimmed text to its division, else null."""
    return lookup(F.upper(F.substring(F.trim(c), 1, 1)), names)


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """A small literal mapping; anything not in it is null."""
    out = F.lit(None).cast("string")
    for key, value in reversed(table.items()):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out
