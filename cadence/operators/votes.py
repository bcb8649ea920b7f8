"""Listening votes and vectors: preferences, opinion scores, cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of votes as files and as the server write them.
FILES = "listener string, clip string, pair string, side_a_file string, side_b_file string, preferred string, blind string, mos_a string, mos_b string, comment string"
SERVER = "listener string, clip_id string, preferred string, blind string, mos_a string, mos_b string, comment string, timestamp string"


def unify(files: DataFrame, server: DataFrame) -> DataFrame:
    """Votes of both kinds under one set of columns."""
    return files.withColumnRenamed("clip", "clip_id").unionByName(server, allowMissingColumns=True)


def condition(file: Column) -> Column:
    return F.nullif(F.regexp_extract(file, "_([A-D])\\.wav$", 1), F.lit(""))


def preferred(votes: DataFrame) -> DataFrame:
    """Votes with ``won``: the condition of the preferred side, or tie."""
    won = F.when(F.lower("preferred") == "a", condition(F.col("side_a_file"))).when(F.lower("preferred") == "b", condition(F.col("side_b_file"))).otherwise("tie")
    return votes.withColumn("won", won)


def preference(votes: DataFrame) -> DataFrame:
    """(pair, won, n, share) of the votes of each pair."""
    held = preferred(votes).groupBy("pair", "won").agg(F.count("*").alias("n"))
    total = held.groupBy("pair").agg(F.sum("n").alias("total"))
    return held.join(total, "pair").select("pair", "won", "n", (F.col("n") / F.col("total")).alias("share"))


def opinion(votes: DataFrame) -> DataFrame:
    """(condition, n, mos): both sides' scores by condition."""
    sides = F.array(*[F.struct(condition(F.col(f"side_{s}_file")).alias("condition"), F.col(f"mos_{s}").try_cast("double").alias("mos")) for s in "ab"])
    each = votes.select(F.explode(sides).alias("x")).select("x.*").filter("condition is not null and mos is not null")
    return each.groupBy("condition").agg(F.count("*").alias("n"), F.avg("mos").alias("mos"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
