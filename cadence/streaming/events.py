"""Structured Streaming over event files: sessions with a watermark, an idempotent queue, running counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import ranges
from cadence.operators.blocks import followed
from cadence.pinning import pinned, shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir), or a local one where none is named."""
    base = shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replay(events: DataFrame, order: str, files: int, path: str) -> None:
    """Write rows as files whose names and times follow the order column, so that a file stream reads them in time order."""
    # pinned: ranges are drawn from a sample, and would be others if the rows were dealt again for each file
    held = pinned(events.repartitionByRange(files, order).withColumn("__part", F.spark_partition_id()))
    for k in range(files):
        held.filter(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(path)


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Event-time sessions of each key: start, end (last event + gap), events."""
    w = F.session_window(at, gap)
    out = stream.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windowed(stream: DataFrame, key: str, at: str, size: str, late: str) -> DataFrame:
    """Tumbling event-time windows of each key."""
    out = stream.withWatermark(at, late).groupBy(key, F.window(at, size).alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("start"), "events")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, to Parquet."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def deliver(stream: DataFrame, roles: DataFrame, out: str, checkpoint: str, at: str | None = None, keep: str = "7 days") -> None:
    """Fan messages (id, to, ...) out to their recipients, each (id, recipient) once however often a message or a batch comes again.

    What was delivered is the stream's state, by key: a batch reads its own rows only, and a restart goes on from the checkpoint. With a column
    of arrival times what is older than ``keep`` is forgotten; without one all is remembered. A message with an unknown recipient fails whole.
    """
    known = [r[0] for r in roles.select("role").distinct().limit(1001).collect()]
    if len(known) > 1000:
        raise ValueError("more than 1000 roles")
    to = F.split("to", ",")
    whole = stream.filter(F.size(F.array_except(to, F.array(*[F.lit(r) for r in known]))) == 0).withColumn("recipient", F.explode(F.array_distinct(to)))
    once = whole.withWatermark(at, keep).dropDuplicatesWithinWatermark(["id", "recipient"]) if at else whole.select("id", "recipient").dropDuplicates()
    run_once(once.select("id", "recipient"), out, checkpoint)


def smooth_levels(rows: DataFrame, key: str, at: str, value: str, attack: float, release: float) -> DataFrame:
    """One-pole smoothing of gains from 1 on: a fall below the state is followed by attack, a rise by release (0..1). A key is as many
    blocks of rows as it needs, and the state is carried over them by their maps. Keys are never null."""
    held = ranges.placed(rows.select(key, at, value), [key], [at]).withColumn("block", F.floor(F.col("place") / ranges.CHUNK).cast("long"))
    bounds = held.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    low, high = (1.0, 1.0) if bounds[0] is None else (min(1.0, bounds[0]), max(1.0, bounds[1]))
    one = F.struct(F.col("place"), F.col(at), F.col(value))
    blocks = pinned(held.groupBy(key, "block").agg(F.array_sort(F.collect_list(one)).alias("__r")))  # CHUNK rows each
    gains = blocks.select(key, "block", F.transform("__r", lambda r: r[value].cast("double")).alias("samples"))
    smooth = followed(gains, [key], attack, release, low, high).withColumnRenamed("samples", "__s")
    both = blocks.join(smooth, [key, "block"]).select(key, F.explode(F.arrays_zip("__r", "__s")).alias("__x"))
    return both.select(key, f"__x.__r.{at}", f"__x.__r.{value}", F.col("__x.__s").alias("smooth"))
