"""Delimited tables: typed by column role, never by inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.functions.dates import to_day
from gridmere.functions.numbers import number_or_null_zero, to_number
from gridmere.functions.text import code_key, label_flags, labels_of, matches_code
from gridmere.operators.tables import not_null


def read_text_table(
    spark: SparkSession, path: str | list[str], line_breaks: bool = False
) -> DataFrame:
    """
    A CSV with a header, every column a string; quotes inside quoted fields are doubled.

    With `line_breaks`, quoted fields may hold them. Such files can't be split between tasks, so
    it is a choice of the source: many small files are fine, a single large one is not.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks)
    return reader.csv(path)


def type_columns(
    df: DataFrame, numbers: Sequence[str] = (), dates: Sequence[str] = (), codes: Sequence[str] = ()
) -> DataFrame:
    """Columns cast by role where present; what does not parse becomes null."""
    casts = {c: to_number(F.col(c)) for c in numbers if c in df.columns}
    casts |= {c: to_day(F.col(c)) for c in dates if c in df.columns}
    casts |= {c: F.col(c).cast("string") for c in codes if c in df.columns}
    return df.withColumns(casts) if casts else df


def type_listings(raw: DataFrame, flags: Mapping[str, str] = fixed.LABEL_FLAGS) -> DataFrame:
    """The named listing columns that exist, typed, with the label list turned to flags."""
    df = raw.select(*[c for c in fixed.LISTING_COLUMNS if c in raw.columns])
    df = type_columns(df, fixed.LISTING_NUMBERS, fixed.LISTING_DATES)
    if "postcode" in df.columns:
        df = df.withColumn("postcode", F.col("postcode").try_cast("double").try_cast("long"))
    if "structured_features" in df.columns:
        df = df.withColumn("structured_features", labels_of(F.col("structured_features")))
        df = df.select("*", *label_flags(F.col("structured_features"), flags)).drop("structured_features")
    return df


def read_listings(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    return type_listings(read_text_table(spark, path, line_breaks))


def read_master(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """The master table: codes stay text, measures are numbers, dates are dates."""
    return type_columns(
        read_text_table(spark, path, line_breaks), fixed.MASTER_NUMBERS, fixed.MASTER_DATES, fixed.MASTER_CODES
    )


def type_weekly_index(raw: DataFrame, series: Sequence[str] = fixed.INDEX_SERIES) -> DataFrame:
    """postcode, date and value columns; 0 means missing; rows need a key and a date."""
    present = [c for c in series if c in raw.columns]
    return raw.select(
        F.col("postcode").try_cast("double").try_cast("long").alias("postcode"),
        to_day(F.col("date")).alias("date"),
        *[number_or_null_zero(F.col(c)).alias(c) for c in present],
    ).where(not_null("postcode", "date"))


def read_weekly_index(
    spark: SparkSession, path: str, series: Sequence[str] = fixed.INDEX_SERIES
) -> DataFrame:
    """An absent file, or one without its key columns, is an empty table."""
    schema = "postcode long, date date, " + ", ".join(f"{c} double" for c in series)
    try:
        raw = read_text_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if not {"postcode", "date"} <= set(raw.columns):
        return spark.createDataFrame([], schema)
    return type_weekly_index(raw, series)


def read_first_match(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The first file below a folder whose name matches; an error when none does."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    try:
        files = sorted(reader.text(folder).inputFiles())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = []
    if not files:
        raise FileNotFoundError(f"no {pattern} below {folder}")
    return read_text_table(spark, files[0])


def positional(df: DataFrame, positions: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Columns by position under new names, for tables without a usable header."""
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(n) for i, n in zip(positions, names)])


def snapshot(
    df: DataFrame, code: str, columns: Mapping[str, str], key: str = "sa2_code_2021",
    digits: int = 8, numeric: bool = True,
) -> DataFrame:
    """An area table: code normalised, one state kept, measures renamed."""
    out = df.select(
        code_key(F.col(code)).alias(key),
        *[(to_number(F.col(c)) if numeric else F.col(c)).alias(n) for c, n in columns.items()],
    )
    return out.where(matches_code(F.col(key), digits))


# --- wide grids -------------------------------------------------------------


def forward_labels(labels: Sequence[str | None]) -> list[str | None]:
    """A header written once per block, repeated over the block's columns."""
    out, last = [], None
    for v in labels:
        last = v if v else last
        out.append(last)
    return out


def grid_to_long(
    body: DataFrame, key: str, header: Sequence[tuple[str, str | None, str]],
    measures: Mapping[str, str] = fixed.INCOME_MEASURES, period: str = "financial_year",
) -> DataFrame:
    """
    A wide grid under a two-row header to key, period, measure, value.

    `header` lists (column, measure label or None, period label) in column order; a
    label covers the columns up to the next one and counts by how it begins. Values
    are text with thousands separators; anything else becomes null.
    """
    labels = forward_labels([m for _, m, _ in header])
    picked = {}
    for (column, _, when), label in zip(header, labels):
        text = (label or "").strip().lower()
        name = next((n for start, n in measures.items() if text.startswith(start)), None)
        if name:
            picked[column] = (name, when)
    cells = F.array(
        *[
            F.struct(
                F.lit(when).alias(period), F.lit(name).alias("measure"),
                F.col(c).cast("string").alias("text"),
            )
            for c, (name, when) in picked.items()
        ]
    )
    return body.select(key, F.inline(cells)).select(
        key, period, "measure", to_number(F.replace("text", F.lit(","), F.lit(""))).alias("value")
    )


def years_to_long(wide: DataFrame, key: str, value: str) -> DataFrame:
    """One column per year to key, year, value."""
    years = [c for c in wide.columns if c.isdigit() and len(c) == 4]
    long = wide.select(key, *[to_number(F.col(c)).alias(c) for c in years]).unpivot(
        [key], years, "year", value
    )
    return long.withColumn("year", F.col("year").cast("int"))


# --- sinks ------------------------------------------------------------------


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> None:
    """Parquet for further work, CSV with a header for exchange; sorted only on request."""
    out = df.orderBy(*order_by) if order_by else df
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
