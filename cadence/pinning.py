"""Cutting lineage: checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset (tests) a folder that is set here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and held.isDefined():
        named = held.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cadence-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def pinned(df: DataFrame) -> DataFrame:
    """The rows as they are now: later uses read them from the shared folder, whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
