"""Declarative constraints: one evaluator over a table of rules, for option records, edit specs and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Commands of an edit spec, their arguments and kinds (n number, s text, xy two numbers "x,y", or choices).
NUMBER, TEXT, POINT = "number", "text", "point"
COMMANDS = {
    "video zoom": {"pct": NUMBER, "curve": NUMBER, "easing": ("smooth", "out", "in", "linear"), "direction": ("grow", "shrink", "pulse"), "anchor": POINT, "start": NUMBER, "end": NUMBER, "hold": NUMBER, "pulse_dur": NUMBER, "max_pulses": NUMBER},
    "video magnify": {"center": POINT, "radius": NUMBER, "grid": TEXT, "hold": NUMBER, "move_dur": NUMBER, "sharpen": NUMBER, "start": NUMBER, "end": NUMBER},
    "video teleport": {"start": NUMBER, "end": NUMBER, "shift": TEXT},
    "video stabilize": {"smoothing": NUMBER, "max_shift": NUMBER},
    "audio lowpass": {"cutoff": NUMBER, "transition": NUMBER, "start": NUMBER, "end": NUMBER},
    "audio transition": {"from": TEXT, "to": TEXT, "at": NUMBER, "dur": NUMBER, "mood": TEXT, "key": TEXT, "curve": NUMBER, "easing": TEXT, "gain": NUMBER},
    "audio riser": {"mood": TEXT, "hit": NUMBER, "dur": NUMBER, "gain": NUMBER, "seed": NUMBER, "tail": NUMBER},
    "audio melody": {"mood": TEXT, "from": TEXT, "to": TEXT, "duck": NUMBER, "seed": NUMBER, "gain": NUMBER, "bars": NUMBER, "start": NUMBER},
}
LEVELS = ["light", "medium", "aggressive"]
ASPECTS = ["9:16", "keep"]
RESERVED = ["id", "from", "recipient", "created_at", "enqueued_at", "dequeued_at", "completed_at", "role"]
ALLOWED = {"git_handoff": ["type", "to", "priority", "task", "commit"], "note": ["type", "to", "priority", "message"]}


def errors(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold (a rule describes what is wrong)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for name, wrong in rules]))


def check(rows: DataFrame, rules: list[tuple[str, Column]], strict: bool = False) -> DataFrame:
    """Rows with ``errors``; strict fails on the first row that has any."""
    out = rows.withColumn("errors", errors(rules))
    return out.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(F.array_join("errors", "; "))).otherwise(F.col("errors"))) if strict else out


def out_of_range(value: Column, low: float | None = None, high: float | None = None, open_low: bool = False) -> Column:
    wrong = F.lit(False)
    if low is not None:
        wrong = wrong | ((value <= low) if open_low else (value < low))
    return wrong | (value > high) if high is not None else wrong


def argument_errors(specs: DataFrame, spark_args: str = "args", command: str = "cmd") -> DataFrame:
    """(all columns, arg, error) of effect rows with a text map of arguments: unknown command, unknown argument, value of the wrong kind.

    The allowed arguments are a constant table that is joined to the exploded maps.
    """
    table = [(c, a, k if isinstance(k, str) else "choice", [] if isinstance(k, str) else list(k)) for c, args in COMMANDS.items() for a, k in args.items()]
    allowed = F.broadcast(specs.sparkSession.createDataFrame(table, "__c string, __a string, __k string, __choices array<string>"))
    given = specs.select(*specs.columns, F.explode_outer(spark_args).alias("arg", "value"))
    met = given.join(allowed, (F.col(command) == F.col("__c")) & (F.col("arg") == F.col("__a")), "left")
    number = F.col("value").try_cast("double").isNotNull() | F.col("value").isin("true", "false")
    bad = (
        F.when(~F.col(command).isin(*COMMANDS), "unknown command")
        .when(F.col("arg").isNull(), None)
        .when(F.col("__k").isNull(), "unknown argument")
        .when((F.col("__k") == NUMBER) & ~F.coalesce(number, F.lit(False)), "not a number")
        .when((F.col("__k") == POINT) & ~F.coalesce(F.col("value").rlike("^\\[? *-?[0-9.]+ *, *-?[0-9.]+ *\\]?$"), F.lit(False)), "not a point")
        .when((F.col("__k") == "choice") & ~F.coalesce(F.array_contains("__choices", F.col("value")), F.lit(False)), "not a choice")
    )
    return met.withColumn("error", bad).filter("error is not null").select(*[c for c in specs.columns if c != spark_args], "arg", "error").distinct()


def spec_errors(level: Column, aspect: Column, crf: Column, max_dur: Column) -> Column:
    return errors([("level", ~level.isin(*LEVELS)), ("aspect", ~aspect.isin(*ASPECTS)), ("crf", out_of_range(crf, 0, 51, True)), ("max_dur", max_dur <= 0)])


def unknown_entries(rows: DataFrame, keys: Column, known: list[str]) -> DataFrame:
    """(key, n) of keys (a column of arrays) that are not known: what a strict reader would refuse, with how often it stands."""
    return rows.select(F.explode(F.array_except(keys, F.array(*[F.lit(k) for k in known]))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def message_errors(headers: Column, roles: list[str]) -> Column:
    """All that is wrong with a message's header map."""
    h = lambda k: F.try_element_at(headers, F.lit(k))
    blank = lambda k: F.coalesce(F.trim(h(k)), F.lit("")) == ""
    to = F.split(h("to"), ",", -1)
    git, note = h("type") == "git_handoff", h("type") == "note"
    keys = F.map_keys(headers)
    stray = lambda kind: F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ALLOWED[kind]]))) > 0
    return errors([
        ("type missing", blank("type")), ("to missing", blank("to")), ("priority missing", blank("priority")),
        ("type unknown", ~blank("type") & ~h("type").isin(*ALLOWED)), ("priority not two digits", ~blank("priority") & ~h("priority").rlike("^[0-9][0-9]$")),
        ("recipient empty", ~blank("to") & F.exists(to, lambda r: F.trim(r) == "")), ("recipient has underscore", F.exists(to, lambda r: r.contains("_"))),
        ("recipient twice", ~blank("to") & (F.size(to) != F.size(F.array_distinct(to)))), ("recipient unknown", ~blank("to") & F.exists(to, lambda r: (F.trim(r) != "") & ~r.isin(*roles))),
        ("header not allowed", (git & stray("git_handoff")) | (note & stray("note"))), ("commit missing", git & blank("commit")),
        ("commit not ten hex digits", git & ~blank("commit") & ~h("commit").rlike("^[0-9a-fA-F]{10}$")), ("task missing", git & blank("task")), ("task too long", git & (F.length(h("task")) > 80)),
        ("message missing", note & blank("message")), ("message too long", note & (F.length(h("message")) > 80)),
    ])


def resolve_prefix(asked: DataFrame, objects: DataFrame, prefix: str, name: str) -> DataFrame:
    """Asked prefixes with the one object that starts with them, null where none or several do."""
    met = asked.join(objects, objects[name].startswith(asked[prefix]), "left").groupBy(prefix).agg(F.count(name).alias("matches"), F.min(name).alias(name))
    return met.withColumn(name, F.when(F.col("matches") == 1, F.col(name)))
