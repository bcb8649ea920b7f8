"""Framed series: tumbling levels, masks, rolling statistics, decay fits, splits and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators import ranges


def decibels(rms: Column) -> Column:
    return 20 * F.log10(rms + F.lit(1e-12))


def levels(rows: DataFrame, keys: list[str], at: str, value: str, size: int) -> DataFrame:
    """RMS level in dB, peak and crest of every whole frame of ``size`` consecutive places; a partial last frame is dropped."""
    held = rows.withColumn("frame", F.floor(F.col(at) / size).cast("long")).groupBy(*keys, "frame").agg(F.count("*").alias("__n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("peak"))
    crest = F.when(F.col("rms") <= 1e-12, 0.0).otherwise(20 * F.log10(F.col("peak") / F.col("rms")))
    return held.filter(F.col("__n") == size).select(*keys, "frame", decibels(F.col("rms")).alias("level_db"), "peak", crest.alias("crest_db"))


def active(frames: DataFrame, keys: list[str], level: str, share: float = 0.75, below: float = 12.0, floor: float = -50.0) -> DataFrame:
    """Frames with ``active``: above the key's share-quantile (interpolated) less ``below``, and above the floor."""
    limits = ranges.quantiles(frames, keys, level, share).select(*keys, F.greatest(F.lit(floor), F.col("quantile") - below).alias("__limit"))
    return frames.join(limits, keys).withColumn("active", F.col(level) > F.col("__limit")).drop("__limit")


def align(fine: DataFrame, coarse: DataFrame, keys: list[str], at: str, flag: str, factor: int) -> DataFrame:
    """A coarse mask on a grid ``factor`` times as fine; places that it does not reach are false."""
    held = coarse.select(*keys, F.col(at).alias("__at"), flag)
    return fine.withColumn("__at", F.floor(F.col(at) / factor).cast("long")).join(held, [*keys, "__at"], "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("__at")


def ratio_split(rows: DataFrame, keys: list[str], value: str, flag: Column) -> DataFrame:
    """Signal-to-noise ratio in dB (-10..40) of flagged against other rows, with a confidence; null if a side is empty."""
    power = F.col(value) * F.col(value)
    held = rows.groupBy(*keys).agg(F.avg(F.when(flag, power)).alias("s"), F.avg(F.when(~flag, power)).alias("n"), F.avg(flag.cast("double")).alias("share"))
    snr = F.least(F.greatest(10 * F.log10(F.col("s") / F.nullif("n", F.lit(0.0))), F.lit(-10.0)), F.lit(40.0))
    return held.select(*keys, snr.alias("snr_db"), F.when(snr.isNotNull(), F.least(F.lit(0.3) + F.col("share"), F.lit(0.95))).alias("confidence"))


def rolling_median(rows: DataFrame, keys: list[str], at: str, value: str, half: int) -> DataFrame:
    """Centred median of up to 2 * half + 1 rows (fewer at the ends)."""
    return ranges.windowed(rows, keys, [at], half, half, median=lambda around: F.percentile(value, 0.5).over(around))


def moving_average(rows: DataFrame, keys: list[str], at: str, value: str, taps: int) -> DataFrame:
    """Centred sum of ``taps`` rows over taps: taps // 2 before the row, the others from it on; beyond the ends stand zeros."""
    return ranges.windowed(rows, keys, [at], taps // 2, (taps - 1) // 2, smooth=lambda around: F.sum(value).over(around) / taps)


def emphasis(rows: DataFrame, keys: list[str], at: str, level: str, factor: float = 1.2, share: float = 0.35) -> DataFrame:
    """Regions above max(factor * mean, share * peak): first, last, peak and the centroid weighted by the excess."""
    limits = rows.groupBy(*keys).agg(F.greatest(F.avg(level) * factor, F.max(level) * share).alias("limit"))
    held = rows.join(limits, keys)
    order = Window.partitionBy(*keys).orderBy(at)
    held = held.withColumn("__on", F.col(level) > F.col("limit"))
    held = held.withColumn("__g", F.row_number().over(order) - F.row_number().over(Window.partitionBy(*keys, "__on").orderBy(at))).filter("__on")
    excess = F.col(level) - F.col("limit")
    return held.groupBy(*keys, "__g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max(level).alias("peak"), (F.sum(excess * F.col(at)) / F.sum(excess)).alias("centre")).drop("__g")


def decay(rows: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Least-squares slope and R2 of each group of at least ``least`` rows that decays, and the time to fall by 60."""
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    return fit.filter((F.col("n") >= least) & (F.col("slope") < 0)).withColumn("fall_60", -60.0 / F.col("slope"))


def clip(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))  # least and greatest pass over nulls


def noise_score(snr: Column) -> Column:
    return F.when(snr.isNull(), 50.0).otherwise(clip(30 + 3 * snr))


def clarity_score(share: Column) -> Column:
    return F.when(share.isNull(), 50.0).otherwise(clip(100 * share))


def loudness_score(lufs: Column, target: float = -14.0) -> Column:
    return F.when(lufs.isNull(), 50.0).otherwise(clip(100 - 5 * F.abs(lufs - target)))


def room_score(rt60: Column, confidence: Column) -> Column:
    """Worse with reverberation over 0.25 s, drawn to 60 where the estimate is unsure; over 2 s it counts as 2 and hardly sure."""
    sure = F.when(rt60 > 2, confidence * 0.3).otherwise(confidence)
    base = 100 - F.least(F.lit(70.0), F.greatest(F.lit(0.0), (F.least(rt60, F.lit(2.0)) - 0.25) * 150))
    return F.when(rt60.isNull(), 60.0).otherwise(clip(60 * (1 - sure) + base * sure))


def dynamics_score(lra: Column, crest: Column) -> Column:
    parts = F.array_compact(F.array(F.when(lra.isNotNull(), 100 - F.least(F.lit(50.0), 8 * F.abs(lra - 8))), F.when(crest.isNotNull(), 100 - F.least(F.lit(50.0), 3 * F.abs(crest - 11)))))
    return F.when(F.size(parts) == 0, 60.0).otherwise(clip(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)))


# Weights of the five scores and bounds of the verdicts.
WEIGHTS = {"noise": 0.25, "clarity": 0.25, "loudness": 0.20, "room": 0.15, "dynamics": 0.15}
VERDICTS = [(80, "good"), (60, "fair")]


def composite(scores: dict[str, Column]) -> Column:
    """Weighted sum of sub-scores, each rounded to one decimal before."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.round(scores[name], 1) * weight
    return total


def verdict(value: Column) -> Column:
    out = F.when(value >= VERDICTS[0][0], VERDICTS[0][1])
    for least, name in VERDICTS[1:]:
        out = out.when(value >= least, name)
    return out.otherwise("poor")


def reverb_label(rt60: Column) -> Column:
    return F.when(rt60.isNull(), "unknown").when(rt60 < 0.25, "dry").when(rt60 < 0.4, "low").when(rt60 < 0.7, "medium").otherwise("high")


def stationary(mean: Column, deviation: Column, n: Column) -> Column:
    return (n > 4) & (deviation / (F.abs(mean) + 1e-9) < 0.35)


def noise_kind(hum: Column, tonal: Column, still: Column, broad: Column, rumble: Column, speech: Column, clicks: Column) -> Column:
    """The first kind that fits, in a fixed order of rules."""
    return (
        F.when(hum, "hum").when(tonal & still, "fan").when(broad & still & rumble, "ac").when(broad & still, "hiss").when((speech < 0.1) & (clicks >= 8), "keyboard")
        .when(~still & broad & rumble, "traffic").when(~still & (speech > 0.5), "people").when(~still & tonal, "music").when(~still, "non-stationary").when(still, "stationary").otherwise("unknown")
    )


def proxy(presence: Column, mud: Column) -> Column:
    """Logistic share from two band levels."""
    return 1 / (1 + F.exp(-(presence - mud) / 6))
