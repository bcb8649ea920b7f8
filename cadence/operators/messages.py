"""A priority message queue as tables: parsing, fan-out, delivery, dequeueing by task or batch, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.pinning import pinned


def parse(text: Column) -> Column:
    """Headers (map) and body of ``key: value`` lines, an empty line and the rest."""
    parts = F.split(text, "\n\n", 2)
    lines = F.filter(F.split(parts[0], "\n"), lambda l: l.contains(": "))  # noqa: E741
    entry = lambda l: F.struct(F.split(l, ": ", 2)[0].alias("k"), F.try_element_at(F.split(l, ": ", 2), F.lit(2)).alias("v"))  # noqa: E731, E741
    named = F.transform(lines, entry)
    first = F.filter(named, lambda e, i: ~F.exists(F.slice(named, 1, i), lambda b: b["k"] == e["k"]))
    return F.struct(F.map_from_entries(first).alias("headers"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("body"))


def line_errors(text: Column, reserved: list[str], allowed: list[str]) -> Column:
    """What is wrong with each line of a draft: (line, error)."""
    lines = F.split(text, "\n")
    blank_at = F.array_position(F.transform(lines, lambda l: F.trim(l)), F.lit(""))  # noqa: E741
    key = lambda l: F.split(l, ": ", 2)[0]  # noqa: E731, E741
    after = lambda i: (blank_at > 0) & (i + 1 > blank_at)

    def error(l: Column, i: Column) -> Column:  # noqa: E741
        value = F.try_element_at(F.split(l, ": ", 2), F.lit(2))
        before = F.transform(F.filter(F.slice(lines, 1, i), lambda x: x.contains(": ")), key)
        return (
            F.when(after(i) & (F.trim(l) != ""), "body not allowed").when(after(i) | (F.trim(l) == ""), None).when(~l.contains(": "), "not a header")
            .when((F.trim(key(l)) == "") | (F.coalesce(F.trim(value), F.lit("")) == ""), "empty").when(key(l).isin(*reserved), "reserved")
            .when(~key(l).isin(*allowed), "unknown").when(F.array_contains(before, key(l)), "duplicate")
        )

    return F.filter(F.transform(lines, lambda l, i: F.struct((i + 1).alias("line"), error(l, i).alias("error"))), lambda e: e["error"].isNotNull())


def render(headers: Column, order: list[str]) -> Column:
    """Header lines: the named ones first, the others by name."""
    rest = F.array_except(F.array_sort(F.map_keys(headers)), F.array(*[F.lit(k) for k in order]))
    keys = F.concat(F.filter(F.array(*[F.lit(k) for k in order]), lambda k: F.map_contains_key(headers, k)), rest)
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.try_element_at(headers, k))), "\n")


def upsert(headers: Column, key: str, value: Column) -> Column:
    """Headers with one set, whether it was there or not."""
    return F.map_concat(F.map_filter(headers, lambda k, v: k != key), F.create_map(F.lit(key), value))


def fan_out(messages: DataFrame, roles: DataFrame, to: str = "to", role: str = "role") -> tuple[DataFrame, DataFrame]:
    """(delivered rows, failed messages): a row for each recipient; a message with an unknown recipient fails whole."""
    each = messages.withColumn("recipient", F.explode(F.split(to, ",")))
    known = each.join(roles.select(F.col(role).alias("__r")).distinct(), F.col("recipient") == F.col("__r"), "left")
    ids = messages.columns
    failed = known.filter("__r is null").select(*ids).distinct()
    bad = known.withColumn("__bad", F.max(F.col("__r").isNull().cast("int")).over(Window.partitionBy("id")))
    return bad.filter("__bad = 0").select(*ids, "recipient"), failed


def undelivered(rows: DataFrame, delivered: DataFrame) -> DataFrame:
    """Rows that were not delivered before: delivering twice adds nothing."""
    return rows.join(delivered.select("id", "recipient"), ["id", "recipient"], "left_anti")


def next_task(pending: DataFrame, role: str, order: list[str]) -> DataFrame:
    """The first pending message of each role."""
    w = Window.partitionBy(role).orderBy(*order)
    return pending.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def next_batch(pending: DataFrame, role: str, priority: str) -> DataFrame:
    """All pending messages of each role that share its first priority; a grouped minimum joined back, no sort."""
    least = pending.groupBy(role).agg(F.min(priority).alias(priority))
    return pending.join(least, [role, priority], "left_semi")


def in_process(held: DataFrame, role: str) -> DataFrame:
    """What each role works on: ``again`` to redeliver, ``ambiguous`` if there are several."""
    return held.groupBy(role).agg(F.count("*").alias("n"), F.min("id").alias("id")).withColumn("state", F.when(F.col("n") > 1, "ambiguous").otherwise("again"))


def complete(held: DataFrame, done: DataFrame, key: str, begun: str, ended: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(completed, waiting): what was worked on and is done, with the days that took, and what is not done yet. A key that ends twice ends the last time."""
    last = done.groupBy(key).agg(F.max(ended).alias(ended))
    own = held.select(key, begun, *by)
    return own.join(last, key).withColumn("days", F.date_diff(ended, begun)), own.join(last, key, "left_anti")


def advance(messages: DataFrame, done: DataFrame, now: Column, order: list[str], role: str = "role", batch: str | None = None) -> DataFrame:
    """The queue one step on: messages (id, role, ..., dequeued_at, completed_at) after what is done (id, ended).

    What was worked on and is done is stamped with its (last) end. A role that works on nothing any more is given its next pending message,
    or, with a column for batches, all pending ones that share the next one's value there; they are stamped with ``now``. The same steps again
    change nothing but what is free by then. Of each role one row is kept while this is worked out.
    """
    ended = done.groupBy("id").agg(F.max("ended").alias("__ended"))
    held = messages.join(ended, "id", "left").withColumn("completed_at", F.coalesce("completed_at", F.when(F.col("dequeued_at").isNotNull(), F.col("__ended")))).drop("__ended")
    pending, busy = F.col("dequeued_at").isNull(), F.col("dequeued_at").isNotNull() & F.col("completed_at").isNull()
    state = held.groupBy(F.col(role).alias("__role")).agg(F.max(busy).alias("__busy"), F.min(F.when(pending, F.struct(*order, "id"))).alias("__next"))
    met = held.join(state, F.col(role).eqNullSafe(F.col("__role")))
    own = (F.col(batch) == F.col(f"__next.{batch}")) if batch else (F.col("id") == F.col("__next.id"))
    return met.select(*[F.when(pending & ~F.col("__busy") & own, now).otherwise(F.col(c)).alias(c) if c == "dequeued_at" else F.col(c) for c in messages.columns])


def batch_text(messages: DataFrame, role: str, order: list[str], text: str = "text") -> DataFrame:
    """(role, text): a role's messages as one text, each after its number from 1 and how many there are. An empty batch is no batch: it fails."""
    if not messages.limit(1).count():
        raise ValueError("an empty batch")
    every = F.array_sort(F.collect_list(F.struct(*order, text)))
    held = messages.groupBy(role).agg(every.alias("__m"))
    shown = F.transform("__m", lambda m, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("/"), F.size("__m").cast("string"), F.lit("]\n"), m[text]))
    return held.select(role, F.array_join(shown, "\n\n").alias("text"))


def latency(completed: DataFrame, by: list[str], days: str = "days") -> DataFrame:
    """How long completed work took: n, least, most and total days by group."""
    return completed.groupBy(*by).agg(F.count("*").alias("n"), F.min(days).alias("least"), F.max(days).alias("most"), F.sum(days).alias("total"))


def sequence(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Numbers in arrival order, without sorting all rows in one task: ranges of the order are numbered apart and shifted by those before."""
    sorted_ = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    held = pinned(sorted_).withColumns({"__p": F.shiftright("__id", 33), "__i": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = held.groupBy("__p").agg(F.count("*").alias("__n"))
    shift = sizes.withColumn("__s", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return held.join(F.broadcast(shift), "__p").withColumn("sequence", F.col("__s") + F.col("__i") + 1 + start).drop("__id", "__p", "__i", "__s")
