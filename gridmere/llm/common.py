"""Small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The blanks that separate words and are stripped from lines: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *others: Column) -> DataFrame:
    """The two columns every text operator works on, under fixed names, and `others`; null texts are empty."""
    return df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        *others,
    )


def per_batch(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int | None = None
) -> DataFrame:
    """
    Applies `work` to one Arrow batch after another, in slices of at most `most` rows; batches
    without rows are passed over.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, most or max(1, batch.num_rows)):
                if (made := work(batch.slice(at, most))) is not None:
                    yield made

    return df.mapInArrow(batches, schema)


def two_hashes(*columns: Column) -> tuple[Column, Column]:
    """128 bits of hash as two longs, for keys that stand for whole texts."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)
