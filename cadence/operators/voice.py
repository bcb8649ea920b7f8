"""What a recording is like, from its frames: voice gate, breaths, clicks, plosives, reverberation, a report and its score.

Frames are rows (keys, frame, level_db, ...) of 10 ms unless said; bands come as columns of levels, so all of it is window
expressions and grouped aggregates within a clip.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators import frames as R
from cadence.operators.intervals import runs


def gate(frames: DataFrame, keys: list[str], flag: str = "active", least: float = 0.05, strict: bool = False) -> DataFrame:
    """Clips with their share of speech; those under the least are left out, or fail if strict."""
    held = frames.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("speech_ratio"))
    if strict:
        return held.withColumn("speech_ratio", F.when(F.col("speech_ratio") < least, F.raise_error(F.lit("no speech"))).otherwise(F.col("speech_ratio")))
    return held.filter(F.col("speech_ratio") >= least)


def breaths(frames: DataFrame, keys: list[str], quiet: float = -30.0, least: float = -55.0, high: str = "high_db", low: str = "low_db") -> DataFrame:
    """Quiet runs of 100 to 800 ms, neither silent nor alone, with more energy above 1 kHz than below: first and last frame."""
    order = Window.partitionBy(*keys).orderBy("frame")
    f = frames.withColumn("__q", F.col("level_db") < quiet)
    near = lambda a, b: F.max((~F.col("__q")).cast("int")).over(order.rowsBetween(a, b))
    f = f.withColumns({"__before": near(-30, -1), "__after": near(1, 30)})
    f = f.withColumn("__g", F.row_number().over(order) - F.row_number().over(Window.partitionBy(*keys, "__q").orderBy("frame"))).filter("__q")
    f = f.withColumn("__tail", F.max("frame").over(Window.partitionBy(*keys, "__g")))
    held = f.groupBy(*keys, "__g").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.max(F.when(F.col("frame") < F.col("__tail"), F.col("level_db"))).alias("peak"),
        F.min_by("__before", "frame").alias("before"), F.max_by("__after", "frame").alias("after"), F.sum(F.pow(F.lit(10.0), F.col(high) / 10)).alias("hi"), F.sum(F.pow(F.lit(10.0), F.col(low) / 10)).alias("lo"),
    )
    ok = (F.col("last") - F.col("first")).between(10, 80) & F.col("peak").between(least, quiet) & ((F.col("before") == 1) | (F.col("after") == 1)) & (F.col("hi") > F.col("lo"))
    return held.filter(ok).select(*keys, "first", "last")


def clicks(frames: DataFrame, keys: list[str], level: str = "band_db", half: int = 125, above: float = 12.0, floor: float = -50.0, frame_ms: int = 2) -> DataFrame:
    """Runs of 5 to 40 ms far above the centred median (fewer frames at the ends; the sequential form repeats the end frames)."""
    f = R.rolling_median(frames, keys, "frame", level, half)
    held = runs(f, keys, "frame", (F.col(level) - F.col("median") > above) & (F.col(level) > floor))
    return held.filter((F.col("length") * frame_ms).between(5, 40))


def _differs(frames: Iterable[dict]) -> float:
    """Level of the powers of ``s`` less that of ``m``, added in the frames' order by the C library's functions."""
    s, m = (10 * math.log10(reduce(add, [math.pow(10.0, f[c] / 10) for f in frames if f[c] is not None])) for c in "sm")
    return s - m


def plosives(frames: DataFrame, keys: list[str], flag: str = "active", sub: str = "sub_db", mid: str = "mid_db", onset: int = 5, above: float = 6.0) -> DataFrame:
    """Speech runs whose first frames have more energy below 150 Hz than above, by ``above`` dB."""
    starts = runs(frames, keys, "frame", F.col(flag)).select(*keys, F.col("first").alias("__a"))
    held = frames.join(starts, keys).filter((F.col("frame") >= F.col("__a")) & (F.col("frame") < F.col("__a") + onset))
    power = lambda c: 10 * F.log10(F.sum(F.pow(F.lit(10.0), F.col(c) / 10)))
    each = F.array_sort(F.collect_list(F.struct("frame", F.col(sub).cast("double").alias("s"), F.col(mid).cast("double").alias("m"))))
    first = held.groupBy(*keys, F.col("__a").alias("first")).agg((power(sub) - power(mid)).alias("__d"), each.alias("__f"))
    # Spark's powers and logarithms differ in the last place from the C library's, which databases have: on the bound the latter decide
    near = F.filter(F.when(F.abs(F.col("__d") - above) < 1e-6, F.col("__f")), lambda f: f["s"].isNotNull() | f["m"].isNotNull())
    exact = F.pandas_udf(lambda found: found.map(_differs, na_action="ignore").astype(float), "double")
    return first.filter(F.coalesce(exact(near), "__d") > above).select(*keys, "first")


def tails(frames: DataFrame, keys: list[str], flag: str = "active", speech: int = 30, silence: int = 20, step: float = 0.01) -> DataFrame:
    """Each speech run's decay into the silence after it: slope, fit, 60 dB time and confidence; the clip's best comes by ``rt60``."""
    said = runs(frames, keys, "frame", F.col(flag)).filter(F.col("length") > speech)
    order = Window.partitionBy(*keys).orderBy("first")
    every = runs(frames, keys, "frame", F.col(flag)).withColumn("__next", F.lead("first").over(order)).select(*keys, "first", "__next")
    ends = frames.groupBy(*keys).agg(F.max("frame").alias("__end"))
    said = said.join(every, [*keys, "first"]).join(ends, keys).withColumn("__stop", F.coalesce(F.col("__next") - 1, F.col("__end"))).filter(F.col("__stop") - F.col("last") >= silence)
    tail = frames.join(said.select(*keys, "last", "__stop"), keys).filter((F.col("frame") > F.col("last")) & (F.col("frame") <= F.col("__stop")))
    head = tail.filter(F.col("frame") <= F.col("last") + 10).groupBy(*keys, "last").agg(F.max("level_db").alias("__head"))
    sizes = tail.groupBy(*keys, "last").agg(F.count("*").alias("__n"))
    region = tail.join(head, [*keys, "last"]).filter((F.col("level_db") >= F.col("__head") - 35) & (F.col("level_db") <= F.col("__head") - 3))
    region = region.withColumn("__x", (F.row_number().over(Window.partitionBy(*keys, "last").orderBy("frame")) - 1) * step)
    fit = R.decay(region, [*keys, "last"], "__x", "level_db").filter((F.col("slope") < -0.5) & (F.col("fall_60") <= 10))
    return fit.join(sizes, [*keys, "last"]).withColumn("confidence", F.least(F.col("r2") * F.col("n") / F.col("__n"), F.lit(0.95))).drop("__n")


def rt60(found: DataFrame, keys: list[str]) -> DataFrame:
    """The decay of most confidence of each clip (the first of equals), with its label."""
    best = found.groupBy(*keys).agg(F.max_by(F.struct("fall_60", "confidence"), F.struct("confidence", (-F.col("last")).alias("l"))).alias("b"))
    return best.select(*keys, F.col("b.fall_60").alias("rt60_s"), F.col("b.confidence").alias("confidence"), R.reverb_label(F.col("b.fall_60")).alias("reverb"))


def count_confidence(n: Column, base: float = 0.3, step: float = 0.05) -> Column:
    return F.least(F.lit(base) + step * n, F.lit(0.9))


def report(frames: DataFrame, keys: list[str], flag: str = "active") -> DataFrame:
    """A row a clip: speech ratio, SNR, levels, reverberation and a verdict over them."""
    power = F.pow(F.lit(10.0), F.col("level_db") / 10)
    held = frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.avg(F.col(flag).cast("double")).alias("speech_ratio"), (10 * F.log10(F.avg(F.when(F.col(flag), power)) / F.nullif(F.avg(F.when(~F.col(flag), power)), F.lit(0.0)))).alias("snr"), F.max("level_db").alias("peak_db"), F.avg("level_db").alias("mean_db"), F.stddev_pop("level_db").alias("dev"))
    room = rt60(tails(frames, keys, flag), keys)
    out = held.join(room, keys, "left").withColumn("snr_db", F.when(F.col("snr").isNotNull(), R.clip(F.col("snr"), -10.0, 40.0)))
    out = out.withColumn("stationary", R.stationary(F.col("mean_db"), F.col("dev"), F.col("frames")))
    score = R.composite({"noise": R.noise_score(F.col("snr_db")), "clarity": R.clarity_score(F.lit(None).cast("double")), "loudness": R.loudness_score(F.col("mean_db")), "room": R.room_score(F.col("rt60_s"), F.coalesce("confidence", F.lit(0.0))), "dynamics": R.dynamics_score(F.lit(None).cast("double"), F.col("peak_db") - F.col("mean_db"))})
    return out.withColumn("score", F.round(score, 1)).withColumn("verdict", R.verdict(F.col("score"))).drop("snr", "dev")
