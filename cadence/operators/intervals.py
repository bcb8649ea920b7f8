"""Interval algebra on timelines: runs, merging, gap trimming, quantising, overlap rejection, spacing.

Intervals are half-open [start, end) in any one numeric unit. Every operator works within the key columns,
as window expressions over rows sorted by time, or by ranges of them (``runs``, ``first_come``); none gathers a key's rows in Python except
``self_apart`` in another order than by start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from cadence.operators import ranges
from cadence.operators.blocks import starts
from cadence.pinning import pinned


def runs(rows: DataFrame, keys: list[str], at: str, flag: Column) -> DataFrame:
    """Stretches of consecutive rows for which flag holds: keys, first, last (both inclusive) and length."""
    held = ranges.placed(rows.select(*keys, at, F.coalesce(flag, F.lit(False)).alias("__f")), keys, [at])
    return ranges.islands(held.filter("__f").drop("__f"), keys, at)


def consecutive(rows: DataFrame, keys: list[str], at: str, step: int = 1) -> DataFrame:
    """Stretches of values of ``at`` that follow each other by step: keys, first, last and length."""
    held = ranges.placed(rows.select(*keys, at).distinct(), keys, [at]).withColumn("__g", F.col(at) - F.col("place") * step)
    return held.groupBy(*keys, "__g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("__g")


def expand(spans: DataFrame, before: Column | float, after: Column | float, low: Column | float | None = None) -> DataFrame:
    """Spans widened on both sides, not below ``low``."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    start = F.col("start") - as_column(before)
    return spans.withColumns({"start": start if low is None else F.greatest(start, as_column(low)), "end": F.col("end") + as_column(after)})


def merge(spans: DataFrame, keys: list[str], slack: float = 0) -> DataFrame:
    """Union of overlapping or touching spans (apart by slack at most): keys, start, end and how many made it."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    held = spans.withColumn("__new", F.coalesce((F.col("start") > before + slack).cast("int"), F.lit(1)))
    held = held.withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy(*keys, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans")).drop("__g")


def gaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps between a key's disjoint spans: start, end."""
    order = Window.partitionBy(*keys).orderBy("start")
    return spans.select(*keys, F.lag("end").over(order).alias("g0"), F.col("start").alias("g1")).filter("g1 > g0").select(*keys, F.col("g0").alias("start"), F.col("g1").alias("end"))


def trim(spans: DataFrame, keys: list[str], trigger: float, target: float) -> DataFrame:
    """Disjoint spans with their gaps: a gap longer than trigger keeps its first target, a shorter one stays.

    kind is ``span`` or ``gap``; a gap's head is kept, never its middle.
    """
    kept = gaps(spans, keys).withColumn("end", F.when(F.col("end") - F.col("start") > trigger, F.col("start") + target).otherwise(F.col("end")))
    return spans.select(*keys, "start", "end", F.lit("span").alias("kind")).unionByName(kept.withColumn("kind", F.lit("gap")))


def keep_parts(spans: DataFrame, keys: list[str], trigger: float, target: float, slack: float = 0) -> DataFrame:
    """What is left of the timeline after trimming, touching parts as one."""
    return merge(trim(spans, keys, trigger, target).filter("end > start"), keys, slack)


def cuts(parts: DataFrame, keys: list[str], total: Column | None = None, begin: float = 0) -> DataFrame:
    """How many cuts the parts imply: gaps between them, and before the first and after the last if total is given."""
    order = Window.partitionBy(*keys).orderBy("start")
    held = parts.withColumn("__cut", (F.col("start") > F.lag("end").over(order)).cast("int"))
    count = F.coalesce(F.sum("__cut"), F.lit(0))
    if total is not None:
        count = count + (F.min("start") > begin).cast("int") + (F.max("end") < F.max(total)).cast("int")
    return held.groupBy(*keys).agg(count.alias("cuts"), F.count("*").alias("parts"), F.sum(F.col("end") - F.col("start")).alias("kept"))


def quantize(spans: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Spans on a grid of fps steps a unit (half to even), as whole steps; those under half a step go, touching ones merge."""
    snapped = spans.withColumns({"start": F.rint(F.col("start") * fps).cast("long"), "end": F.rint(F.col("end") * fps).cast("long")}).filter("end > start")
    return merge(snapped, keys)


def inside(points: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Points that lie in a span, with ``packed``: their place on the timeline that only has the spans (disjoint).

    Points and spans are sorted into one line of each key, where a point sees the last span that began: no point meets every span.
    """
    order = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.col("end") - F.col("start")).over(order), F.lit(0)) - F.col("start")
    point = F.struct(*[F.col(c) for c in points.columns])
    kind = points.select(point.alias("p")).schema["p"].dataType
    line = spans.select(*keys, F.col("start").alias("__t"), F.struct("end", shift.alias("shift")).alias("__span"), F.lit(None).cast(kind).alias("__point"))
    line = line.unionByName(points.select(*keys, F.col(at).alias("__t"), F.lit(None).cast(line.schema["__span"].dataType).alias("__span"), point.alias("__point")))
    before = Window.partitionBy(*keys).orderBy("__t", F.col("__point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("__span", F.last("__span", True).over(before)).filter(F.col("__point").isNotNull() & (F.col("__t") < F.col("__span.end")))
    return met.select("__point.*", (F.col("__t") + F.col("__span.shift")).alias("packed"))


def reject_overlaps(spans: DataFrame, busy: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Spans that overlap no busy span of their key by more than most.

    A span does if, of the busy spans (longer than most) that begin before its end less most, one ends after its start and most: a running
    maximum over one sorted line of each key.
    """
    row = F.struct(*[F.col(c) for c in spans.columns])
    kind = spans.select(row.alias("r")).schema["r"].dataType
    line = busy.filter(F.col("end") - F.col("start") > most).select(*keys, F.col("start").cast("double").alias("__t"), F.col("end").alias("__e"), F.lit(None).cast(kind).alias("__row"))
    line = line.unionByName(spans.select(*keys, (F.col("end") - most).cast("double").alias("__t"), F.lit(None).cast(line.schema["__e"].dataType).alias("__e"), row.alias("__row")))
    # of equal times the span comes first: a busy span that begins just there does not overlap by more
    before = Window.partitionBy(*keys).orderBy("__t", F.col("__row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("__e", F.max("__e").over(before)).filter(F.col("__row").isNotNull())
    hit = (F.col("__e") > F.col("__row.start") + most) & (F.col("__row.end") - F.col("__row.start") > most)
    return met.filter(~F.coalesce(hit, F.lit(False))).select("__row.*")


def overlap_notes(spans: DataFrame, busy: DataFrame, keys: list[str], most: float) -> DataFrame:
    """All spans with ``overlap``: the longest time above most by which they overlap a busy span of their key; null: they stay.

    A busy span inside another can't overlap longer than that and is left out; the others end in the order in which they begin, so those that
    a span overlaps have consecutive numbers, which one sorted line of each key tells. A span meets these only.
    """
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = busy.select(*keys, "start", "end").withColumn("__l", last).filter("__l is null or end > __l")
    outer = outer.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"), F.row_number().over(Window.partitionBy(*keys).orderBy("start")).alias("__n"))
    held = pinned(spans.withColumn("__id", F.monotonically_increasing_id()))
    none = F.lit(None)

    def line(rows: DataFrame, at: str, turn: int, begun: Column = none, ended: Column = none, own: Column = none) -> DataFrame:
        return rows.select(*keys, F.col(at).cast("double").alias("__t"), F.lit(turn).alias("__turn"), begun.cast("int").alias("__begun"), ended.cast("int").alias("__ended"), own.cast("long").alias("__id"))

    # at a span's start all that end by then have ended, at its end those that begin before it have begun
    number = F.col("__n")
    every = line(held, "end", 0, own=F.col("__id")).unionByName(line(outer, "__s", 1, begun=number)).unionByName(line(outer, "__e", 1, ended=number)).unionByName(line(held, "start", 2, own=F.col("__id")))
    before = Window.partitionBy(*keys).orderBy("__t", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = every.withColumns({"__begun": F.max("__begun").over(before), "__ended": F.max("__ended").over(before)}).filter("__id is not null")
    reach = seen.groupBy("__id").agg(F.max(F.when(F.col("__turn") == 2, F.coalesce("__ended", F.lit(0)) + 1)).alias("__from"), F.max(F.when(F.col("__turn") == 0, F.col("__begun"))).alias("__to"))
    near = held.join(reach, "__id").withColumn("__n", F.explode(F.when(F.col("__to") >= F.col("__from"), F.sequence("__from", "__to"))))
    met = near.join(outer, [*keys, "__n"]).select("__id", (F.least("end", "__e") - F.greatest("start", "__s")).alias("o")).filter(F.col("o") > most)
    return held.join(met.groupBy("__id").agg(F.max("o").alias("overlap")), "__id", "left").drop("__id")


def first_come(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that overlap none of their key that stayed before, by start (ties: the shorter first); touching is allowed.

    What stays depends on when the last that stayed ends: a state, which a block of spans takes from what it was to what it becomes by
    an increasing step function. Those compose, so a key is as many blocks as it needs. Keys are never null.
    """
    held = ranges.placed(spans, keys, ["start", "end"]).withColumn("block", F.floor(F.col("place") / ranges.CHUNK).cast("long"))
    row = F.struct(*[F.col(c) for c in ["place", *spans.columns]])
    blocks = pinned(held.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(row)).alias("__r")))  # CHUNK rows each
    times = blocks.select(*keys, "block", F.transform("__r", lambda r: r["start"].cast("double")).alias("s"), F.transform("__r", lambda r: r["end"].cast("double")).alias("e"))

    def maps(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.assign(map=[step_map(np.asarray(s, float), np.asarray(e, float)) for s, e in zip(batch["s"], batch["e"])])[[*keys, "block", "map"]]

    def stay(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for starts_, ends_, state in zip(batch["s"], batch["e"], batch["state"]):
                last, own = float(state[0]), []
                for s, e in zip(starts_, ends_):
                    own.append(s >= last)
                    last = e if s >= last else last
                out.append(own)
            yield batch.assign(stays=out)[[*keys, "block", "stays"]]

    kinds = [spans.schema[k] for k in keys]
    made = times.mapInPandas(maps, StructType([*kinds, StructField("block", LongType()), StructField("map", ArrayType(DoubleType()))]))
    begun = starts(made, keys, step_after, step_apply, [float("-inf")])
    told = times.join(begun, [*keys, "block"]).mapInPandas(stay, StructType([*kinds, StructField("block", LongType()), StructField("stays", ArrayType(BooleanType()))]))
    both = blocks.join(told, [*keys, "block"]).select(F.explode(F.arrays_zip("__r", "stays")).alias("__x")).filter("__x.stays")
    return both.select(*[F.col(f"__x.__r.{c}").alias(c) for c in spans.columns])


def step_map(s: np.ndarray, e: np.ndarray) -> list[float]:
    """The step function of spans in order of start: for a state up to each of its first numbers the state after them, the second numbers;
    above the last nothing stays and the state is what it was."""
    after, up = np.empty(len(s)), np.searchsorted(s, e)
    for k in range(len(s) - 1, -1, -1):
        nxt = max(int(up[k]), k + 1)
        after[k] = after[nxt] if nxt < len(s) else e[k]
    return _steps(s, after)


def _steps(upto: np.ndarray, after: np.ndarray) -> list[float]:
    """Steps of one height as one."""
    last = np.append(after[1:] != after[:-1], True)
    return [*upto[last].tolist(), *after[last].tolist()]


def step_apply(m: np.ndarray, state: np.ndarray) -> np.ndarray:
    n = len(m) // 2
    k = int(np.searchsorted(m[:n], state[0]))
    return np.array([m[n + k]]) if k < n else np.asarray(state, float)


def step_after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The function of a, then b."""
    n, k = len(a) // 2, len(b) // 2
    through = np.array([step_apply(b, np.array([v]))[0] for v in a[n:]])
    later = b[:k] > a[n - 1]
    return np.array(_steps(np.concatenate([a[:n], b[:k][later]]), np.concatenate([through, b[k:][later]])))


def self_apart(spans: DataFrame, keys: list[str], order: str, schema: str) -> DataFrame:
    """Greedy: in the given order, a span stays unless it overlaps one that stayed (touching is allowed). By start no key is one task's
    (first_come); in any other order a key is."""
    if order == "start":
        return first_come(spans, keys)

    def run(batch):
        from bisect import bisect

        starts, ends, rows = [], [], []  # of what stays, in order of time
        for row in batch.sort_values(order, kind="stable").itertuples(index=False):
            k = bisect(starts, row.start)
            if (k == 0 or ends[k - 1] <= row.start) and (k == len(starts) or row.end <= starts[k]):
                starts.insert(k, row.start)
                ends.insert(k, row.end)
                rows.append(row)
        return type(batch)(rows, columns=batch.columns)

    return spans.groupBy(*keys).applyInPandas(run, schema)


def spaced(rows: DataFrame, keys: list[str], at: str, weight: str, apart: float, most: int) -> DataFrame:
    """Greedy choice per key: by weight (ties: the later), at most ``most`` rows, each ``apart`` from those chosen.

    A round chooses the first row of each key, a grouped maximum that is taken before anything is shuffled, and leaves out what is too
    near to it; there are ``most`` rounds at most, and no key is one task's.
    """
    left = rows.select(*keys, at, weight)
    if apart <= 0:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(weight), F.desc(at)))
        return left.withColumn("__n", place).filter(F.col("__n") <= most).drop("__n")
    chosen = None
    for turn in range(most):
        top = pinned(left.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(F.struct(F.col(weight).alias("w"), F.col(at).alias("t"))).alias("__top")))
        own = top.select(*[F.col(f"__{k}").alias(k) for k in keys], F.col("__top.t").alias(at), F.col("__top.w").alias(weight))
        chosen = own if chosen is None else chosen.unionByName(own)
        if turn + 1 < most:
            left = left.join(top, ranges.same([F.col(k) for k in keys], [F.col(f"__{k}") for k in keys])).filter(F.abs(F.col(at) - F.col("__top.t")) >= apart).select(*keys, at, weight)
            if turn % 8 == 7:  # not read again from the first for each round
                left = pinned(left)
                if not left.limit(1).count():
                    break
    return chosen
