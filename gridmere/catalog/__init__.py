"""
The registered queries: each runs one operator, or a composed plan, over whole
tables, with an equivalent DuckDB query where SQL can express it.
"""

from gridmere.catalog.registry import ORACLES, QUERIES
from gridmere.catalog import (  # noqa: F401  (importing registers)
    aggregates, areas, asof, cleaning, columns, expressions, joins, models, places, plans, quality,
    scans,
)

__all__ = ["ORACLES", "QUERIES"]
