"""Scenario tables: expansion by examples, placeholders, routing of steps to the first handler that fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.scalars import fill

#: Schema of a feature document.
FEATURE = "name string, background array<struct<keyword string, text string>>, scenarios array<struct<name string, steps array<struct<keyword string, text string>>, examples array<map<string, string>>>>"


def expand(features: DataFrame) -> DataFrame:
    """(feature, scenario_index, example_index, name, example, steps): one row for each example, one with an empty example where there are none."""
    s = features.select(F.col("name").alias("feature"), F.coalesce("background", F.array()).alias("background"), F.posexplode("scenarios").alias("scenario_index", "s"))
    nothing = F.array(F.create_map().cast("map<string,string>"))
    rows = F.when(F.size(F.coalesce("s.examples", F.array())) > 0, F.col("s.examples")).otherwise(nothing)
    e = s.select("feature", "background", "scenario_index", "s", F.posexplode(rows).alias("i", "example"))
    return e.select("feature", "scenario_index", (F.col("i") + 1).alias("example_index"), F.concat("s.name", F.lit("/example_"), (F.col("i") + 1).cast("string")).alias("name"), "example", F.concat("background", "s.steps").alias("steps"))


def steps(executions: DataFrame) -> DataFrame:
    """One row a step, its placeholders filled; a placeholder without a value fails."""
    e = executions.select("feature", "scenario_index", "example_index", "example", F.posexplode("steps").alias("step", "s"))
    return e.select("feature", "scenario_index", "example_index", "step", "s.keyword", fill(F.col("s.text"), F.col("example")).alias("text"))


def route(rows: DataFrame, handlers: list[tuple[str, str]], key: list[str], text: str = "text") -> DataFrame:
    """Rows with the first handler whose pattern matches the whole text, ``unsupported`` where none does.

    Handlers are a constant list, so matching is one expression, no join.
    """
    out = F.lit("unsupported")
    for name, pattern in reversed(handlers):
        out = F.when(F.col(text).rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return rows.withColumn("handler", out)


def run(executions: DataFrame, handlers: dict, schema: str = "feature string, scenario_index int, example_index int, ok boolean, failure string") -> DataFrame:
    """Run executions with Python handlers (pattern -> function of world, match); each has a fresh world and never raises."""
    import re

    compiled = [(re.compile(p), f) for p, f in handlers.items()]

    def work(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                world, failure = {}, None
                for step in row.steps:
                    text = step["text"]
                    for name, value in (row.example or {}).items():
                        text = text.replace(f"<{name}>", value)
                    found = next(((f, m) for p, f in compiled if (m := p.fullmatch(text))), None)
                    try:
                        if found is None:
                            raise LookupError(f"no handler for: {text}")
                        found[0](world, found[1])
                    except Exception as e:  # noqa: BLE001  a failure is a result here
                        failure = str(e)
                        break
                out.append((row.feature, row.scenario_index, row.example_index, failure is None, failure))
            yield pd.DataFrame(out, columns=["feature", "scenario_index", "example_index", "ok", "failure"])

    return executions.select("feature", "scenario_index", "example_index", F.map_entries("example").alias("__e"), "example", "steps").drop("__e").mapInPandas(work, schema)


def first_match(rows: DataFrame, patterns: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """As ``route`` for handlers in a table (pattern, handler, ordinal): the least ordinal that matches."""
    met = rows.join(patterns, F.expr(f"{text} rlike concat('^(?:', pattern, ')$')"))
    return met.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))).filter("__n = 1").drop("__n", "pattern", "ordinal")
