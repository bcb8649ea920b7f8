"""Plug points: named engines, and their registration as Spark functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

_ENGINES: dict[str, Callable] = {}


def register(name: str, make: Callable) -> None:
    """An engine by name; ``make`` takes its options."""
    _ENGINES[name] = make


def engine(name: str, **options):
    """A new engine, or None where there is none of that name."""
    make = _ENGINES.get(name)
    return None if make is None else make(**options)


def names() -> list[str]:
    return sorted(_ENGINES)


def to_spark(spark: SparkSession, functions: dict[str, Callable] | None = None, tables: dict[str, type] | None = None) -> None:
    """Vectorised functions and table functions under names that SQL can call."""
    for name, function in (functions or {}).items():
        spark.udf.register(name, function)
    for name, table in (tables or {}).items():
        spark.udtf.register(name, table)
