"""Recordings as many rows: (keys, block, samples), blocks numbered from 0, any number of samples in each.

What depends on all that came before (recursive filters, followers) is a state carried from block to block. A block's
effect on the state is a map that composes: affine for filters, increasing and piecewise linear for followers. ``starts``
composes the maps of a span of blocks, goes over the spans of a key, and then over the blocks of each span, so a recording is
no task's work; only the small maps are shuffled for it. What depends on neighbours (resampling, loudness windows) takes a
halo of samples or sums of short parts instead. Keys are never null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from cadence.operators import mastering as M
from cadence.operators import signal as K
from cadence.pinning import pinned
from cadence.plans.staged import resolve_preset

#: Blocks (or spans) that one fold goes over.
SPAN = 1024

Section = tuple


def cut(samples: DataFrame, keys: list[str], at: str, value: str, size: int) -> DataFrame:
    """Rows of single samples, ``at`` their place from 0, as blocks of ``size``."""
    one = F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("v"))
    held = samples.groupBy(*keys, F.floor(F.col(at) / size).cast("long").alias("block")).agg(F.array_sort(F.collect_list(one)).alias("__s"))
    return held.select(*keys, "block", F.transform("__s", lambda s: s["v"]).alias("samples"))


def uncut(blocks: DataFrame, keys: list[str], size: int, value: str = "value") -> DataFrame:
    """Single samples (keys, at, value) of blocks of ``size``; a key's last may be shorter."""
    return blocks.select(*keys, "block", F.posexplode("samples").alias("__k", value)).select(*keys, (F.col("block") * size + F.col("__k")).alias("at"), value)


# --- states carried from block to block ---


def _fold(width: int, step: Callable, end: Callable | None, schema: StructType):
    """mapInPandas over rows sorted by their first ``width`` columns: step(state, row) -> (state, output row or None) for each row of a
    group, whose first has the state None; end(state) -> output row after its last."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[:width] != now:
                    if now is not None and end:
                        out.append(end(state))
                    now, state = row[:width], None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=schema.names)
        if now is not None and end:
            yield pd.DataFrame([end(state)], columns=schema.names)

    return run


def starts(maps: DataFrame, keys: list[str], compose: Callable, apply: Callable, first: list[float]) -> DataFrame:
    """(keys, block, state): the state each block begins with, from the blocks' maps (keys, block, map array<double>).

    compose(a, b) is the map of a, then b; apply(map, state) the state after it; first is the state before a key's first block.
    """
    n, kinds, numbers = len(keys), [maps.schema[k] for k in keys], ArrayType(DoubleType())
    held = maps.select(*keys, F.floor(F.col("block") / SPAN).cast("long").alias("span"), "block", "map")

    def joined(state, row):  # (keys, span, block, map) -> the span's map
        own = np.asarray(row[n + 2], float)
        return (row[: n + 1], own if state is None else compose(state[1], own)), None

    def begun(place: int, at: int, given: int | None):  # rows with a map at ``at`` -> the state before each; the first may be given one
        def step(state, row):
            if state is None:
                state = np.asarray(first if given is None else row[given], float)
            return apply(np.asarray(row[at], float), state), (*row[:n], row[place], state.tolist())

        return step

    spans_out = StructType([*kinds, StructField("span", LongType()), StructField("map", numbers)])
    spans = held.repartition(*keys, "span").sortWithinPartitions(*keys, "span", "block").mapInPandas(_fold(n + 1, joined, lambda s: (*s[0], s[1].tolist()), spans_out), spans_out)
    span_out = StructType([*kinds, StructField("span", LongType()), StructField("state", numbers)])
    led = spans.repartition(*keys).sortWithinPartitions(*keys, "span").mapInPandas(_fold(n, begun(n, n + 1, None), None, span_out), span_out)
    block_out = StructType([*kinds, StructField("block", LongType()), StructField("state", numbers)])
    whole = held.join(led, [*keys, "span"]).select(*keys, "span", "block", "map", "state").repartition(*keys, "span").sortWithinPartitions(*keys, "span", "block")
    return whole.mapInPandas(_fold(n + 1, begun(n + 1, n + 2, n + 3), None, block_out), block_out)


# --- recursive filters ---


def filtered(blocks: DataFrame, keys: list[str], *sections: Section) -> DataFrame:
    """The blocks through second-order sections whose state goes on from block to block: equal to one pass over the whole recording."""
    order = 2 * len(sections)

    def ends(batches: Iterator) -> Iterator:
        own = K.Cascade(sections)
        for batch in batches:
            yield batch.assign(map=[[float(len(x)), *own.run(x, np.zeros(order))[1]] for x in batch["samples"]])[[*keys, "block", "map"]]

    powers: dict[int, np.ndarray] = {}

    def power(n: int) -> np.ndarray:
        if n not in powers:
            powers[n] = K.Cascade(sections).power(n)
        return powers[n]

    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([[a[0] + b[0]], power(int(b[0])) @ a[1:] + b[1:]])

    def apply(m: np.ndarray, state: np.ndarray) -> np.ndarray:
        return power(int(m[0])) @ state + m[1:]

    def finish(batches: Iterator) -> Iterator:
        own = K.Cascade(sections)
        for batch in batches:
            yield batch.assign(samples=[own.run(x, np.asarray(s, float))[0] for x, s in zip(batch["samples"], batch["state"])]).drop(columns="state")

    kinds = [blocks.schema[k] for k in keys]
    maps = blocks.select(*keys, "block", "samples").mapInPandas(ends, StructType([*kinds, StructField("block", LongType()), StructField("map", ArrayType(DoubleType()))]))
    begun = starts(maps, keys, compose, apply, [0.0] * order)
    out = StructType([StructField("samples", ArrayType(DoubleType())) if f.name == "samples" else f for f in blocks.schema])
    return blocks.join(begun, [*keys, "block"]).select(*blocks.columns, "state").mapInPandas(finish, out)


# --- followers ---


class Follower:
    """One-pole smoothing: falls by attack, rises by release. Over rows it is an increasing, piecewise linear map of the state it
    begins with: kept as the states where it bends (from low to high, which bound the values as well) and the states they lead to."""

    def __init__(self, attack: float, release: float, low: float, high: float):
        self.attack, self.release, self.low, self.high = attack, release, low, high

    def run(self, values: np.ndarray, state: float) -> np.ndarray:
        out = np.empty(len(values))
        for i, v in enumerate(np.asarray(values, float).tolist()):
            state += (self.attack if v < state else self.release) * (v - state)
            out[i] = state
        return out

    def map(self, values: np.ndarray) -> np.ndarray:
        x, y = np.array([self.low, self.high]), np.array([self.low, self.high])
        for v in np.asarray(values, float).tolist():
            if y[0] < v < y[-1]:  # a bend: the state that has come to v
                k = int(np.searchsorted(y, v))
                if y[k] != v:
                    x, y = np.insert(x, k, np.interp(v, y, x)), np.insert(y, k, v)
            y = y + np.where(v < y, self.attack, self.release) * (v - y)
            if len(y) > 2 and y[-1] - y[0] <= 1e-15 * max(abs(y[0]), abs(y[-1])):
                x, y = x[[0, -1]], y[[0, -1]]  # all states have come together
        return np.concatenate([x, y])

    @staticmethod
    def apply(m: np.ndarray, state: np.ndarray) -> np.ndarray:
        n = len(m) // 2
        return np.interp(state, m[:n], m[n:])

    @staticmethod
    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, k = len(a) // 2, len(b) // 2
        # where a bends, and where it leads to a bend of b
        inner = b[1 : k - 1]
        inner = inner[(inner > a[n]) & (inner < a[2 * n - 1])]
        grows = np.append(True, np.diff(a[n:]) > 0)
        x = np.unique(np.concatenate([a[:n], np.interp(inner, a[n:][grows], a[:n][grows])]))
        return np.concatenate([x, np.interp(np.interp(x, a[:n], a[n:]), b[:k], b[k:])])


def followed(blocks: DataFrame, keys: list[str], attack: float, release: float, low: float = 0.0, high: float = 1.0, first: float = 1.0) -> DataFrame:
    """Blocks of gains, all between low and high, smoothed over the whole of each key: falls by attack, rises by release (0..1)."""
    own = Follower(attack, release, low, high)

    def ends(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.assign(map=[own.map(x) for x in batch["samples"]])[[*keys, "block", "map"]]

    def finish(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.assign(samples=[own.run(x, float(s[0])) for x, s in zip(batch["samples"], batch["state"])]).drop(columns="state")

    kinds = [blocks.schema[k] for k in keys]
    maps = blocks.select(*keys, "block", "samples").mapInPandas(ends, StructType([*kinds, StructField("block", LongType()), StructField("map", ArrayType(DoubleType()))]))
    begun = starts(maps, keys, own.compose, own.apply, [first])
    out = StructType([StructField("samples", ArrayType(DoubleType())) if f.name == "samples" else f for f in blocks.schema])
    return blocks.join(begun, [*keys, "block"]).select(*blocks.columns, "state").mapInPandas(finish, out)


# --- neighbours ---


def haloed(blocks: DataFrame, keys: list[str], size: int, before: int, after: int) -> DataFrame:
    """Blocks of ``size`` (a key's last may be shorter) with ``head`` and ``tail``: up to so many samples of the blocks around, which
    are sent as what they are, not with their block. Halos may be longer than a block."""
    back, on = -(-before // size), -(-after // size)
    shifts = F.array(*[F.lit(k) for k in range(-on, back + 1)])
    held = blocks.select(*keys, "block", "samples", F.explode(shifts).alias("__d")).filter(F.col("block") + F.col("__d") >= 0)
    # of a block that stands __d before another, what the other's halo reaches; __d blocks after, its beginning
    n = F.size("samples")
    reach = F.when(F.col("__d") > 0, F.lit(before) - (F.col("__d") - 1) * size).when(F.col("__d") < 0, F.lit(after) + (F.col("__d") + 1) * size)
    part = F.when(F.col("__d") == 0, F.col("samples")).when(F.col("__d") > 0, F.slice("samples", F.greatest(F.lit(1), n - reach + 1), F.greatest(F.lit(0), F.least(n, reach)))).otherwise(F.slice("samples", F.lit(1), F.greatest(F.lit(0), F.least(n, reach))))
    sent = held.select(*keys, (F.col("block") + F.col("__d")).alias("block"), F.struct((-F.col("__d")).alias("d"), part.alias("x")).alias("__p"))
    met = sent.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("__p")).alias("__p"))
    side = lambda f: F.flatten(F.transform(F.filter("__p", f), lambda p: p["x"]))
    met = met.select(*keys, "block", side(lambda p: p["d"] < 0).alias("head"), side(lambda p: p["d"] == 0).alias("samples"), side(lambda p: p["d"] > 0).alias("tail"), F.exists("__p", lambda p: p["d"] == 0).alias("__own"))
    return met.filter("__own").drop("__own")


def kernel(rate: int, to: int, zeros: int = 16) -> np.ndarray:
    """Windowed sinc (so many zero crossings a side) on the grid of both rates, one row a phase: row p weighs the inputs around an
    output that lies p / up of an input step after one."""
    g = np.gcd(rate, to)
    up, scale = to // g, min(1.0, to / rate)
    half = int(np.ceil(zeros / scale))
    at = np.arange(-half, half + 1)[None, :] - np.arange(up)[:, None] / up
    taper = np.where(np.abs(at) <= half, 0.5 + 0.5 * np.cos(np.pi * at / half), 0.0)
    taps = np.sinc(at * scale) * taper
    return taps / taps.sum(1, keepdims=True)


def resampled(blocks: DataFrame, keys: list[str], size: int, rate: int, to: int, zeros: int = 16) -> DataFrame:
    """Blocks of ``size`` samples (a key's last may be shorter) at another rate: polyphase, with halos from the neighbours; beyond the
    recording's ends stand zeros. An output of place k lies at input k * rate / to; there are ceil(n * to / rate) of them."""
    if rate == to:
        return blocks.select(*keys, "block", "samples")
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    taps = kernel(rate, to, zeros)
    half = taps.shape[1] // 2

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for block, head, x, tail in zip(batch["block"], batch["head"], batch["samples"], batch["tail"]):
                start, n = int(block) * size, len(x)
                pad = np.concatenate([np.zeros(half - len(head)), head, x, tail, np.zeros(half - len(tail) + 1)])
                # outputs whose input place, rounded down, is in this block
                first, last = -(-start * up // down), -(-(start + n) * up // down)
                k = np.arange(first, last, dtype=np.int64) * down
                at, phase = k // up - start, (k % up).astype(np.int64)
                view = np.lib.stride_tricks.sliding_window_view(pad, 2 * half + 1)
                made = np.empty(len(k))
                for a in range(0, len(k), 8192):
                    made[a : a + 8192] = np.einsum("ij,ij->i", view[at[a : a + 8192]], taps[phase[a : a + 8192]])
                out.append(made)
            yield batch.assign(samples=out)[[*keys, "block", "samples"]]

    kinds = [blocks.schema[k] for k in keys]
    held = haloed(blocks, keys, size, half, half)
    return held.mapInPandas(run, StructType([*kinds, StructField("block", LongType()), StructField("samples", ArrayType(DoubleType()))]))


# --- dynamics ---

#: Time constants after which nothing is left of what a follower began with (a part in 10^12).
GONE = 28


def _mapped(blocks: DataFrame, keys: list[str], kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """kernel(head, samples, tail) for every haloed block."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            made = [kernel(*(np.asarray(v, float) for v in row)) for row in zip(batch["head"], batch["samples"], batch["tail"])]
            yield batch.assign(samples=made)[[*keys, "block", "samples"]]

    kinds = [blocks.schema[k] for k in keys]
    return blocks.mapInPandas(run, StructType([*kinds, StructField("block", LongType()), StructField("samples", ArrayType(DoubleType()))]))


def compressed(blocks: DataFrame, keys: list[str], size: int, rate: int = 48_000, threshold: float = -24.0, ratio: float = 2.0, attack: float = 0.010, release: float = 0.150) -> DataFrame:
    """Levels above the threshold grow by 1/ratio. A block's level is followed from so far back that where it began is forgotten."""
    before = int(GONE * max(attack, release) * rate)
    return _mapped(haloed(blocks, keys, size, before, 0), keys, lambda head, x, tail: M.compress(np.concatenate([head, x]), rate, threshold, ratio, attack, release)[len(head) :])


def limited(blocks: DataFrame, keys: list[str], size: int, rate: int = 48_000, threshold: float = -1.0, release: float = 0.050, ahead: float = 0.005) -> DataFrame:
    """No sample above the threshold; what a block's gain comes from lies in its halo, before and ahead."""
    before, after = int(GONE * release * rate), max(1, int(ahead * rate))
    return _mapped(haloed(blocks, keys, size, before, after), keys, lambda head, x, tail: M.limit(np.concatenate([head, x, tail]), rate, threshold, release, ahead)[len(head) : len(head) + len(x)])


def deessed(blocks: DataFrame, keys: list[str], size: int, rate: int = 48_000, threshold: float = -8.0, most: float = 6.0, attack: float = 0.001, release: float = 0.075) -> DataFrame:
    """Frames of 10 ms with too much of 4 to 10 kHz are turned down: gains of whole frames, followed over the key, straight lines between
    the frames' centres. A block holds whole frames."""
    frame = rate // 100
    if size % frame:
        raise ValueError(f"blocks of {size} samples don't hold whole frames of {frame}")

    def gains(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.assign(samples=[M.sharpness_gains(np.asarray(x, float), rate, threshold, most) for x in batch["samples"]])

    def apply(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for x, head, own, tail in zip(batch["samples"], batch["head"], batch["gains"], batch["tail"]):
                g = np.concatenate([head, own, tail])
                centres = (np.arange(len(g)) - len(head) + 0.5) * frame
                out.append(np.asarray(x, float) * (np.interp(np.arange(len(x)), centres, g) if len(g) else 1.0))
            yield batch.assign(samples=out)[[*keys, "block", "samples"]]

    schema = StructType([*[blocks.schema[k] for k in keys], StructField("block", LongType()), StructField("samples", ArrayType(DoubleType()))])
    found = blocks.select(*keys, "block", "samples").mapInPandas(gains, schema)
    step = frame / rate
    smooth = followed(found, keys, 1 - np.exp(-step / attack) if attack > 0 else 1.0, 1 - np.exp(-step / release))
    led = haloed(smooth, keys, size // frame, 1, 1).select(*keys, "block", "head", F.col("samples").alias("gains"), "tail")
    return blocks.select(*keys, "block", "samples").join(led, [*keys, "block"]).mapInPandas(apply, schema)


def mastered(blocks: DataFrame, keys: list[str], size: int, preset: str | None = None, lufs: float | None = None, dehum: int | None = None, rate: int = 48_000) -> DataFrame:
    """The mastering chain over blocks: what ``mastering.process`` does to a whole clip, no recording in one row."""
    p = resolve_preset(preset)
    second = K.highpass(p["highpass_hz"], rate)
    sections = [K.dc_block(rate), second, second, *([K.notch(float(dehum), rate)] if dehum else []), *M.eq_sections(rate, p["mud"], p["boxiness"], p["presence"], p["air"])]
    out = filtered(blocks.select(*keys, "block", "samples"), keys, *sections)
    if p["deesser"]:
        out = deessed(out, keys, size, rate, p["deesser_threshold"])
    out = limited(compressed(out, keys, size, rate, p["comp_threshold"], p["comp_ratio"]), keys, size, rate)
    out = pinned(normalised(out, keys, size, rate, p["lufs"] if lufs is None else lufs))
    # a true peak above -1 is limited, and what is left of it taken back by one gain of the key
    loud = peaks(out, keys, size, rate).filter("true_peak_db > -1").select(*keys)
    if not loud.limit(1).count():
        return out
    low = pinned(limited(out.join(loud, keys, "left_semi"), keys, size, rate, -3.0))
    over = peaks(low, keys, size, rate).select(*keys, F.pow(F.lit(10.0), F.least(F.lit(0.0), F.lit(-1.0) - F.col("true_peak_db")) / 20).alias("__g"))
    held = low.join(over, keys).select(*keys, "block", F.transform("samples", lambda v: v * F.col("__g")).alias("samples"))
    return out.join(loud, keys, "left_anti").unionByName(held)


# --- loudness ---


def energies(blocks: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """(keys, hop, energy, n): sums of squares of parts of ``hop`` samples, of blocks of ``size``. Built-in functions only; a part
    may lie in several blocks."""
    at = F.col("block") * size + F.col("__k")
    one = blocks.select(*keys, "block", F.posexplode("samples").alias("__k", "__v"))
    return one.groupBy(*keys, F.floor(at / hop).cast("long").alias("hop")).agg(F.sum(F.col("__v").cast("double") * F.col("__v").cast("double")).alias("energy"), F.count("*").alias("n"))


def windows(parts: DataFrame, keys: list[str], hop: int, hops: int) -> DataFrame:
    """(keys, window, power): mean square of windows of so many whole parts, one from each part on; those beyond the end are left out."""
    spread = F.explode(F.sequence(F.greatest(F.col("hop") - (hops - 1), F.lit(0)), F.col("hop")))
    held = parts.filter(F.col("n") == hop).select(*keys, spread.alias("window"), "energy")
    return held.groupBy(*keys, "window").agg(F.count("*").alias("__n"), (F.sum("energy") / (hop * hops)).alias("power")).filter(F.col("__n") == hops).drop("__n")


def level(power: Column) -> Column:
    return F.lit(-0.691) + 10 * F.log10(power + F.lit(1e-30))


def integrated(parts: DataFrame, keys: list[str], hop: int) -> DataFrame:
    """(keys, lufs): windows of four parts above -70, of these those not more than ten below their mean; two aggregations, no recording in one
    row. Keys without a whole window, or with silence only, are left out."""
    loud = windows(parts, keys, hop, 4).filter(level(F.col("power")) > -70)
    mean = loud.groupBy(*keys).agg((level(F.avg("power")) - 10).alias("__gate"))
    return loud.join(mean, keys).filter(level(F.col("power")) > F.col("__gate")).groupBy(*keys).agg(level(F.avg("power")).alias("lufs"))


def loudness_range(parts: DataFrame, keys: list[str], hop: int) -> DataFrame:
    """(keys, short_term_max, range): levels of windows of thirty parts; the range lies between the tenth and the 95th of a hundred of those above
    -70 and not more than twenty below their mean."""
    held = windows(parts, keys, hop, 30).withColumn("__l", level(F.col("power")))
    top = held.groupBy(*keys).agg(F.max("__l").alias("short_term_max"))
    loud = held.filter(F.col("__l") > -70)
    mean = loud.groupBy(*keys).agg((level(F.avg("power")) - 20).alias("__gate"))
    kept = loud.join(mean, keys).filter(F.col("__l") > F.col("__gate"))
    spread = kept.groupBy(*keys).agg((F.percentile("__l", 0.95) - F.percentile("__l", 0.1)).alias("range"))
    return top.join(spread, keys, "left")


def normalised(blocks: DataFrame, keys: list[str], size: int, rate: int = 48_000, target: float = -16.0) -> DataFrame:
    """Blocks at an integrated loudness: measured over the whole of each key, one gain for it. What is silent, too short or below -70 stays."""
    parts = energies(filtered(blocks, keys, *K.K_WEIGHTING), keys, size, rate // 10)
    gains = integrated(parts, keys, rate // 10).filter("lufs >= -70").select(*keys, F.pow(F.lit(10.0), (F.lit(target) - F.col("lufs")) / 20).alias("__g"))
    held = blocks.join(gains, keys, "left")
    return held.select(*[F.transform("samples", lambda v: v * F.coalesce("__g", F.lit(1.0))).alias("samples") if c == "samples" else F.col(c) for c in blocks.columns])


def peaks(blocks: DataFrame, keys: list[str], size: int, rate: int = 48_000) -> DataFrame:
    """(keys, true_peak_db): the highest level of four times as many samples."""
    fine = resampled(blocks, keys, size, rate, 4 * rate)
    top = F.aggregate("samples", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v)))
    return fine.groupBy(*keys).agg((20 * F.log10(F.max(top) + 1e-12)).alias("true_peak_db"))
