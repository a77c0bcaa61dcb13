"""Spark operators for enriching located, dated records with area and market data."""
