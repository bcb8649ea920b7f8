"""Session defaults: UTC, adaptive execution, partitions sized to the cores."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Tables of the driver's folders.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int | str = "*", app: str = "cadence", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's own session is used as it is."""
    if (held := SparkSession.getActiveSession()) is not None and not conf:
        return held
    if os.environ.get("PYSPARK_GATEWAY_PORT"):  # started by spark-submit, which has said where and how
        return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    n = 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
