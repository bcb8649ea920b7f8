"""Ordered work on keys too large for a task: places within a key by one range sort, chunks of places with halos."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.messages import sequence

#: Rows of a chunk.
CHUNK = 4096


def same(a: list[Column], b: list[Column]) -> Column:
    """Whether two lists of columns are equal, nulls too."""
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & x.eqNullSafe(y)
    return out


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``place``, their number from 0 within their key. One range sort of all rows, which cuts a large key like any other;
    a key's first number is a grouped minimum."""
    held = sequence(rows, [*keys, *order])
    if not keys:
        return held.withColumn("place", F.col("sequence") - 1).drop("sequence")
    first = held.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("sequence").alias("__first"))
    return held.join(first, same([F.col(k) for k in keys], [F.col(f"__{k}") for k in keys])).select(*rows.columns, (F.col("sequence") - F.col("__first")).alias("place"))


def chunked(rows: DataFrame, before: int, after: int, size: int = CHUNK) -> DataFrame:
    """Placed rows with ``chunk``, and again in the chunks beside it where they are within before or after rows of their border (``own`` is
    false there): windows over (keys, chunk) see all that a row's frame needs."""
    size = max(size, before, after)
    chunk, place = F.floor(F.col("place") / size).cast("long"), F.col("place") % size
    beside = F.array_compact(F.array(F.lit(0), F.when(place < after, -1), F.when(place >= size - before, 1)))
    led = rows.withColumn("__d", F.explode(beside)).withColumn("chunk", chunk + F.col("__d")).filter("chunk >= 0")
    return led.withColumn("own", F.col("__d") == 0).drop("__d")


def windowed(rows: DataFrame, keys: list[str], order: list[str], before: int, after: int, **columns) -> DataFrame:
    """Rows with columns over the rows around them: each is given the window of so many rows before and after, whatever the key's size."""
    led = chunked(placed(rows, keys, order), before, after)
    around = Window.partitionBy(*keys, "chunk").orderBy("place").rowsBetween(-before, after)
    for name, make in columns.items():
        led = led.withColumn(name, make(around))
    return led.filter("own").select(*rows.columns, *columns)


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median) of the values that are not null: the middle of each key's places, or the mean of its two middles. Nothing but counts is held
    for a key, however many values it has."""
    held = placed(rows.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value])
    sizes = held.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("__n"))
    met = held.join(sizes, same([F.col(k) for k in keys], [F.col(f"__{k}") for k in keys]))
    middle = F.col("place").isin(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2))
    return met.filter(middle).groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("median"))


def _blend(low: float, high: float, part: float) -> float:
    return math.fma(low, 1 - part, high * part)


def quantiles(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, quantile) of the values that are not null, interpolated between the two places around share * (n - 1) and rounded as DuckDB does it
    (low * (1 - part) fused with high * part); null for a key of nulls only. Nothing but counts is held for a key."""
    held = placed(rows.select(*keys, value), keys, [value])
    sizes = held.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(value).alias("__n"), (F.count("*") - F.count(value)).alias("__nulls"))
    at = F.lit(float(share)) * (F.col("__n") - 1)
    met = held.join(sizes, same([F.col(k) for k in keys], [F.col(f"__{k}") for k in keys])).withColumns({"__at": at, "__low": F.floor(at) + F.col("__nulls"), "__part": at - F.floor(at)})
    pick = lambda place: F.max(F.when(F.col("place") == place, F.col(value).cast("double")))
    around = met.groupBy(*keys).agg(pick(F.col("__low")).alias("__a"), pick(F.col("__low") + 1).alias("__b"), F.max("__part").alias("__part"))
    blend = F.pandas_udf(lambda a, b, p: a.combine(b.fillna(a), lambda x, y: (x, y)).combine(p, lambda v, d: _blend(*v, d)).astype(float), "double")
    mixed = F.when(F.col("__part") > 0, blend("__a", "__b", "__part")).otherwise(F.col("__a"))
    return around.select(*keys, F.when(F.col("__a").isNotNull(), mixed).alias("quantile"))


def islands(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows with ``place`` grouped where places follow each other: keys, first, last (of ``at``) and length. A key's rows are numbered again
    among those given; an island is a group, added up before it is shuffled."""
    again = placed(rows.withColumnRenamed("place", "__was"), keys, ["__was"])
    return again.groupBy(*keys, (F.col("__was") - F.col("place")).alias("__g")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("__g")
