"""Operators for preparing large text corpora; nothing else in the library imports this package."""

from gridmere.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
