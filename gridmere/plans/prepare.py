"""Cleaning the master table and choosing its predictor columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmere.operators.cleaning import clean_listings
from gridmere.operators.columns import Features, select_features
from gridmere.sources.tables import read_master, type_columns, write_table
from gridmere import fixed


def load_clean(spark: SparkSession, path: str, drop_per_room_pricing: bool = True) -> DataFrame:
    """The typed master table (CSV) after every cleaning rule."""
    return clean_listings(read_master(spark, path), drop_per_room_pricing)


def prepare(
    master: DataFrame, folder: str | None = None, drop_per_room_pricing: bool = True, prune: bool = True
) -> tuple[DataFrame, Features]:
    """
    Cleaned rows and their features. With a folder the cleaned table is written first and
    selection reads it back, so that cleaning runs once.
    """
    typed = type_columns(master, fixed.MASTER_NUMBERS, fixed.MASTER_DATES, fixed.MASTER_CODES)
    clean = clean_listings(typed, drop_per_room_pricing)
    if folder:
        write_table(clean, f"{folder.rstrip('/')}/clean")
        clean = clean.sparkSession.read.parquet(f"{folder.rstrip('/')}/clean")
    return clean, select_features(clean, prune)
