"""Small document tables for the corpus operators."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from samples import prose  # noqa: E402

@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeats, ties and a long text, with extra columns."""
    same = prose(120, 1)
    return [
        (1, same, 10), (2, same, 11), (2, same, 11), (None, same, 12), (3, None, 13), (4, "", 14),
        (5, " \t\n ", 15), (6, "one", 16), (7, "One", 17), (8, prose(90, 2), None),
        (9, "A-B é\x1c日本 x", 18), (10, (prose(400, 3) + " ") * 40, 19), (None, None, None),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows, beside their own columns with names that the operators use themselves."""
    schema = "doc_id long, text string, print int"
    rows = spark.createDataFrame(odd_rows, schema)
    return rows.selectExpr(
        "doc_id", "text", "print", "print AS doc", "print AS n", "print AS key", "print AS score",
        "print AS shard", "print AS length", "print AS count", "print AS words",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
