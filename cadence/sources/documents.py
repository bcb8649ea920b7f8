"""Small documents as tables: words, features, briefs, messages, role and window tables, votes, WAV blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators.messages import parse
from cadence.operators.scenarios import FEATURE
from cadence.operators.votes import FILES, SERVER, unify

_WORD = "array<struct<w string, s double, e double>>"


def words(texts: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """Word timings of JSON documents: ``words`` or the words of ``segments`` in order, one row a word with its pos.

    A document of another shape has no words, or fails if strict.
    """
    held = texts.withColumn("__d", F.from_json(column, f"words {_WORD}, segments array<struct<words {_WORD}>>"))
    own = F.coalesce(F.col("__d.words"), F.flatten(F.transform("__d.segments", lambda s: F.coalesce(s["words"], F.array().cast(_WORD)))))
    if strict:
        own = F.when(own.isNull(), F.raise_error(F.lit("neither words nor segments"))).otherwise(own)
    return held.select(*[c for c in texts.columns if c != column], F.posexplode(own).alias("pos", "__w")).select("*", "__w.*").drop("__w")


def features(spark: SparkSession, path: str) -> DataFrame:
    """Feature documents; one without a name or a list of scenarios fails."""
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", FEATURE).alias("f")).select("f.*")
    ok = F.col("name").isNotNull() & F.col("scenarios").isNotNull()
    return held.withColumn("name", F.when(ok, F.col("name")).otherwise(F.raise_error(F.lit("a feature needs a name and scenarios"))))


def briefs(spark: SparkSession, path: str) -> DataFrame:
    """Creative briefs, one JSON object a file."""
    schema = "platform string, objective string, archetype string, cta string, duration_s double, speech string, captions string, music string, source_assets array<string>"
    held = spark.read.text(path, wholetext=True)
    return held.select(F.when(F.trim("value").startswith("{"), F.from_json("value", schema)).otherwise(F.raise_error(F.lit("a brief is one object"))).alias("b")).select("b.*")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Message files: name, headers and body; the name orders by priority, time and sequence."""
    held = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), parse(F.col("value")).alias("m"))
    return held.select("name", "m.headers", "m.body")


def roles(spark: SparkSession, path: str) -> DataFrame:
    """The table of roles; a blank mode is ``task``."""
    schema = "role string, worktree string, path string, session string, display string, agent string, receive_mode string"
    held = spark.read.csv(path, sep="\t", schema=schema)
    return held.withColumn("receive_mode", F.coalesce(F.nullif(F.trim("receive_mode"), F.lit("")), F.lit("task")))


def windows(spark: SparkSession, path: str) -> DataFrame:
    """``window role agent worktree [mode] [args]`` lines: parts, and what is wrong with each."""
    parts = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '#')").select(F.split("line", "\\s+").alias("p"))
    at = lambda k: F.try_element_at("p", F.lit(k))
    held = parts.select(at(1).alias("kind"), at(2).alias("role"), at(3).alias("agent"), at(4).alias("worktree"), F.when(at(5).isin("task", "batch"), at(5)).otherwise("task").alias("mode"), F.slice("p", F.when(at(5).isin("task", "batch"), 6).otherwise(5), 1000).alias("args"))
    again = held.groupBy("role").agg(F.count("*").alias("__n"))
    wrong = F.array_compact(F.array(F.when(F.col("kind") != "window", "not a window"), F.when(F.col("worktree").isNull(), "too short"), F.when(F.col("__n") > 1, "role twice")))
    return held.join(again, "role", "left").withColumn("errors", wrong).drop("__n")


def votes(spark: SparkSession, files: str | None = None, server: str | None = None) -> DataFrame:
    """Votes of both kinds of CSV."""
    empty = lambda s: spark.createDataFrame([], s)
    return unify(spark.read.csv(files, header=True, schema=FILES) if files else empty(FILES), spark.read.csv(server, header=True, schema=SERVER) if server else empty(SERVER))


def wav(spark: SparkSession, path: str, block: int = 48_000) -> DataFrame:
    """WAV files as mono blocks: path, rate, block and samples (float, -1..1), read in ranges; other layouts and rates fail."""
    from cadence.sources.recordings import register

    register(spark)
    return spark.read.format("wav").options(path=path, block=block).load().select("path", "rate", "block", F.col("samples").cast("array<float>").alias("samples"))
