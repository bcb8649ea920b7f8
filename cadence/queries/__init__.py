"""Queries over the driver's tables, each with the same rows in DuckDB's SQL where that can express them."""
