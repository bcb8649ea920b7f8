"""The mastering chain and repairs of recordings: numpy kernels over one bounded clip, run inside Arrow batches by ``master`` and ``mend``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StringType, StructField, StructType

from cadence.operators import signal as K
from cadence.plans.staged import resolve_preset

#: Fixed: rates that are admitted, and the one all kernels work at. Clips that a task masters side by side.
RATES, RATE, TOGETHER = (16_000, 22_050, 44_100, 48_000), 48_000, 16


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """A signal at another rate, by its spectrum: what both rates can hold stays, the rest is zero."""
    x = np.asarray(x, float)
    if rate == to or not len(x):
        return x
    n = max(1, round(len(x) * to / rate))
    f = np.fft.rfft(x)
    held = np.zeros(n // 2 + 1, complex)
    k = min(len(f), len(held))
    held[:k] = f[:k]
    return np.fft.irfft(held, n) * (n / len(x))


def admit(clips: DataFrame, rate: str = "rate") -> DataFrame:
    """Clips at RATE, whatever admitted rate they came with; any other rate fails."""
    fn = F.pandas_udf(lambda s, r: s.combine(r, lambda x, q: resample(np.asarray(x, float), int(q)).astype(np.float32)), ArrayType(FloatType()))
    wrong = F.raise_error(F.concat(F.lit("rate not admitted: "), F.col(rate).cast("string")))
    held = clips.withColumn(rate, F.when(F.col(rate).isin(*RATES), F.col(rate)).otherwise(wrong.cast("int")))
    return held.withColumn("samples", F.when(F.col(rate) == RATE, F.col("samples")).otherwise(fn("samples", rate))).withColumn(rate, F.lit(RATE))


def eq_sections(rate: int = RATE, mud: float = 0.0, boxiness: float = 0.0, presence: float = 0.0, air: float = 0.0) -> list[tuple]:
    """Bells at 180, 450 and 3200 Hz and a shelf at 9 kHz, each held to four decibels; those of zero are left out."""
    sections = [K.peaking(f, rate, q, float(np.clip(g, -4, 4))) for f, q, g in ((180.0, 0.9, mud), (450.0, 1.0, boxiness), (3200.0, 0.8, presence)) if g]
    return [*sections, *([K.highshelf(9000.0, rate, float(np.clip(air, -4, 4)))] if air else [])]


def vocal_eq(x: np.ndarray, rate: int = RATE, mud: float = 0.0, boxiness: float = 0.0, presence: float = 0.0, air: float = 0.0) -> np.ndarray:
    sections = eq_sections(rate, mud, boxiness, presence, air)
    return K.apply_filter(x, *sections) if sections else np.asarray(x, float)


def follow(gains: np.ndarray, attack: float, release: float) -> np.ndarray:
    """One-pole smoothing from 1 on: falls by attack, rises by release (0..1)."""
    return K.followed([gains], release, attack, 1.0)[0]


def spread(gains: np.ndarray, size: int, n: int) -> np.ndarray:
    """Gains of frames at their centres, linearly between them, level beyond the first and last."""
    return np.interp(np.arange(n), (np.arange(len(gains)) + 0.5) * size, gains)


def spread_gains(frames: DataFrame, keys: list[str], frame: str, gain: str, size: int) -> DataFrame:
    """The same over rows: a row (keys, sample, gain) for each sample of each frame, from the frame's neighbours."""
    order = Window.partitionBy(*keys).orderBy(frame)
    held = frames.select(*keys, frame, F.col(gain).alias("__g"), F.coalesce(F.lag(gain).over(order), gain).alias("__b"), F.coalesce(F.lead(gain).over(order), gain).alias("__a"))
    held = held.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    far = (F.col("__k") - F.lit(size / 2)) / F.lit(float(size))  # of the sample from the centre, in frames
    value = F.col("__g") + F.when(far < 0, -far * (F.col("__b") - F.col("__g"))).otherwise(far * (F.col("__a") - F.col("__g")))
    return held.select(*keys, (F.col(frame) * size + F.col("__k")).cast("long").alias("sample"), value.alias("gain"))


def sharpness_gains(x: np.ndarray, rate: int = RATE, threshold: float = -8.0, most: float = 6.0) -> np.ndarray:
    """Gains of the whole frames of 10 ms: the share of 4 to 10 kHz in 0.1 to 10 kHz above the threshold, at most ``most``, is taken off."""
    size = rate // 100
    frames = x[: len(x) // size * size].reshape(-1, size)
    power, f = np.abs(np.fft.rfft(frames, axis=1)) ** 2, np.fft.rfftfreq(size, 1 / rate)
    sharp, whole = (power[:, (f >= low) & (f < 10_000)].sum(1) + 1e-12 for low in (4000, 100))
    loud = 20 * np.log10(np.sqrt((frames**2).mean(1)) + 1e-12) > -50
    return 10 ** (-np.where(loud, np.clip(10 * np.log10(sharp / whole) - threshold, 0, most), 0.0) / 20)


def deess(x: np.ndarray, rate: int = RATE, threshold: float = -8.0, most: float = 6.0, attack: float = 0.001, release: float = 0.075) -> np.ndarray:
    """Frames of 10 ms whose share of 4 to 10 kHz in 0.1 to 10 kHz is above the threshold are turned down by the excess, at most by ``most``."""
    x, size = np.asarray(x, float), rate // 100
    if len(x) < max(256, size):
        return x
    step = size / rate
    gains = follow(sharpness_gains(x, rate, threshold, most), 1 - np.exp(-step / attack) if attack > 0 else 1.0, 1 - np.exp(-step / release))
    return x * spread(gains, size, len(x))


def compress(x: np.ndarray, rate: int = RATE, threshold: float = -24.0, ratio: float = 2.0, attack: float = 0.010, release: float = 0.150) -> np.ndarray:
    """Levels above the threshold grow by 1/ratio; the level is the signal's size, followed sample by sample."""
    return compress_all([np.asarray(x, float)], rate, threshold, ratio, attack, release)[0]


def compress_all(signals: list[np.ndarray], rate: int = RATE, threshold: float = -24.0, ratio: float = 2.0, attack: float = 0.010, release: float = 0.150) -> list[np.ndarray]:
    """``compress`` of each signal, their levels followed side by side."""
    top = 10 ** (threshold / 20)
    levels = K.followed([np.abs(x) for x in signals], 1 - np.exp(-1 / (attack * rate)), 1 - np.exp(-1 / (release * rate)), 0.0)
    return [x * (np.maximum(level, top) / top) ** (1 / ratio - 1) for x, level in zip(signals, levels)]


def limit(x: np.ndarray, rate: int = RATE, threshold: float = -1.0, release: float = 0.050, ahead: float = 0.005) -> np.ndarray:
    """No sample above the threshold: the gain that a peak needs is there ``ahead`` of it and is given back by release."""
    x, top, n = np.asarray(x, float), 10 ** (threshold / 20), max(1, int(ahead * rate))
    if not len(x) or max(x.max(), -x.min()) <= top:
        return x
    need = np.minimum(1.0, top / np.maximum(np.abs(x), 1e-12))
    least, reach = np.concatenate([need, np.ones(n)]), 1  # over the next n samples: of windows twice as wide, then of two that overlap
    while 2 * reach <= n + 1:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(x)], least[n + 1 - reach :][: len(x)])
    out = K.followed([least], 1 - np.exp(-1 / (release * rate)), 1.0, 1.0)[0]
    return x * np.minimum(out, need)


@lru_cache(maxsize=4)
def _turns(n: int) -> np.ndarray:
    """What a quarter of a sample turns each bin of a real transform of n by."""
    return np.exp(0.5j * np.pi / n * np.arange(n // 2 + 1))


def true_peak(x: np.ndarray, above: float | None = None) -> float:
    """The highest level between the samples as well, from four times as many: the spectrum turned by quarters of a sample. Where a bound
    is not ``above`` so many decibels, the bound is given instead."""
    if not len(x):
        return float("-inf")
    n, x, db = len(x), np.asarray(x, float), lambda v: float(20 * np.log10(v + 1e-12))
    f = np.fft.rfft(x)
    last = f[-1].real / n if n % 2 == 0 else 0.0
    if n % 2 == 0:
        f[-1] *= 2  # as in a longer transform, where this bin is not the last
    if above is not None:
        # the lower quarter of the bins by its samples, of which there are eight a period at least; of the others the sum
        low = np.fft.irfft(f[: n // 8], n) if n >= 64 else np.zeros(1)
        rest = f[n // 8 :] if n >= 64 else f
        bound = db(max(low.max(), -low.min()) / np.cos(np.pi / 8) + 2 * np.abs(rest).sum() / n)
        if bound < above - 1e-6:
            return bound
    y = [x[::2] + last, x[1::2] - last]
    top = max(max(v.max(initial=0.0), -v.min(initial=0.0)) for v in y)
    turn = _turns(n) if n <= 1 << 20 else _turns.__wrapped__(n)
    for _ in range(3):
        f *= turn
        y = np.fft.irfft(f, n)
        top = max(top, y.max(), -y.min())
    return db(top)


def to_loudness(x: np.ndarray, rate: int = RATE, target: float = -16.0) -> np.ndarray:
    """The signal at an integrated loudness, its true peak at -1 at most; what is silent or too short stays as it is."""
    now = K.loudness(np.asarray(x, float), rate)
    if now is None or not np.isfinite(now) or now < -70:
        return np.asarray(x, float)
    y = np.asarray(x, float) * 10 ** ((target - now) / 20)
    if true_peak(y, above=-1) > -1:
        y = limit(y, rate, -3.0)
        if (over := true_peak(y) + 1) > 0:
            y = y * 10 ** (-over / 20)
    return y


def short_term(x: np.ndarray, rate: int = RATE, size: float = 3.0) -> np.ndarray:
    """Loudness of blocks of three seconds by a tenth of one (none of a shorter signal)."""
    n, hop = int(size * rate), rate // 10
    if len(x) < n:
        return np.empty(0)
    p = np.cumsum(np.concatenate([[0.0], K.recursed(np.asarray(x, float), *K.K_WEIGHTING) ** 2]))
    at = np.arange(0, len(x) - n + 1, hop)
    return -0.691 + 10 * np.log10((p[at + n] - p[at]) / n + 1e-30)


def loudness_range(x: np.ndarray, rate: int = RATE) -> float | None:
    """Between the tenth and the 95th of a hundred blocks of three seconds, gated at -70 and twenty below the mean of the rest."""
    level = short_term(x, rate)
    level = level[level > -70]
    if not len(level):
        return None
    level = level[level > 10 * np.log10((10 ** (level / 10)).mean()) - 20]
    return float(np.percentile(level, 95) - np.percentile(level, 10))


def process(x: np.ndarray, preset: str | None = None, rate: int = RATE, lufs: float | None = None, dehum: int | None = None, no_eq: bool = False, no_comp: bool = False, no_limit: bool = False, no_loudnorm: bool = False) -> tuple[np.ndarray, list[str]]:
    """The whole chain in its fixed order, with the stages that ran."""
    return process_all([x], preset, rate, lufs, dehum, no_eq, no_comp, no_limit, no_loudnorm)[0]


def process_all(signals: list[np.ndarray], preset: str | None = None, rate: int = RATE, lufs: float | None = None, dehum: int | None = None, no_eq: bool = False, no_comp: bool = False, no_limit: bool = False, no_loudnorm: bool = False) -> list[tuple[np.ndarray, list[str]]]:
    """``process`` of each signal, stage by stage: what goes sample by sample is done for all side by side."""
    p, xs, ran = resolve_preset(preset), [np.asarray(x, float) for x in signals], ["dc_block", "highpass"]
    second = K.highpass(p["highpass_hz"], rate)
    sections = [K.dc_block(rate), second, second]
    if dehum:
        sections.append(K.notch(float(dehum), rate))
        ran.append("dehum")
    if not no_eq:
        sections += eq_sections(rate, p["mud"], p["boxiness"], p["presence"], p["air"])
        ran.append("eq")
    xs = [K.recursed(x, *sections) for x in xs]
    if not no_eq and p["deesser"]:
        xs = [deess(x, rate, p["deesser_threshold"]) for x in xs]
        ran.append("deesser")
    if not no_comp:
        xs = compress_all(xs, rate, p["comp_threshold"], p["comp_ratio"])
        ran.append("compressor")
    if not no_limit:
        xs = [limit(x, rate) for x in xs]
        ran.append("limiter")
    if not no_loudnorm:
        xs = [to_loudness(x, rate, p["lufs"] if lufs is None else lufs) for x in xs]
        ran.append("loudness")
    return [(x, list(ran)) for x in xs]


def master(clips: DataFrame, preset: str | None = None, **switches) -> DataFrame:
    """Clips (…, samples) through the chain, with ``stages``: what ran. One narrow pass; a clip is a row and bounded by its length.
    Samples may be packed (``signal.packed``) and stay so."""
    resolve_preset(preset)  # an unknown one fails before anything runs
    schema = StructType([*[f for f in clips.schema if f.name != "stages"], StructField("stages", ArrayType(StringType()))])
    form = K.packed if isinstance(clips.schema["samples"].dataType, BinaryType) else lambda x: x.astype(np.float32)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for a in range(0, len(batch), TOGETHER):
                part = batch.iloc[a : a + TOGETHER]
                done = process_all([K.unpacked(x) for x in part["samples"]], preset, **switches)
                yield part.assign(samples=[form(x) for x, _ in done], stages=[s for _, s in done])[schema.names]

    return clips.drop("stages").mapInPandas(run, schema)


def deplosive(x: np.ndarray, regions: list[tuple[int, int]], rate: int = RATE, amount: float = 0.6) -> np.ndarray:
    """Regions (first sample, end) lose a part of what they have below 150 Hz, with fades of 5 ms; nothing else changes."""
    out = np.array(x, float)
    for a, b in regions:
        low = K.apply_filter(out[a:b], K.lowpass(150.0, rate))
        fade = max(1, min(rate // 200, (b - a) // 4))
        ramp = np.minimum(1.0, np.minimum(np.arange(b - a), np.arange(b - a)[::-1]) / fade)
        out[a:b] -= amount * low * ramp
    return out


#: Of each level, the seconds above which a pause is cut, and what is left of it.
PAUSES = {"light": (1.2, 0.8), "medium": (0.8, 0.5), "aggressive": (0.5, 0.3)}


def without_pauses(clips: DataFrame, keys: list[str], trigger: float, target: float, rate: int = RATE) -> DataFrame:
    """Clips (keys, samples) without the tails of their long pauses: each by its own frames of 10 ms, grouped by its keys. A clip without any
    speech stays as it is."""
    size = rate // 100
    flags = speech_frames(clips, keys, rate, 10).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "active"))), lambda f: f["active"]).alias("__active"))
    held = clips.join(flags, keys, "left")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for x, active in zip(batch["samples"], batch["__active"]):
                on = np.asarray([] if active is None else active, bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[1], on.astype(np.int8), [1]]))) if on.any() else []
                long = [(int(a * size + rate * target), int(b * size)) for a, b in zip(edge[::2], edge[1::2]) if (b - a) * size > trigger * rate]
                out.append(remove_regions(np.asarray(x, float), long, rate // 500).astype(np.float32) if long else np.asarray(x, np.float32))
            yield batch.drop(columns="__active").assign(samples=out)

    return held.select(*clips.columns, "__active").mapInPandas(run, clips.schema)


def remove_regions(x: np.ndarray, regions: list[tuple[int, int]], fade: int) -> np.ndarray:
    """Without the regions, faded where it is cut. Positions are the given signal's, however many go before."""
    out, at, x = [], 0, np.asarray(x, float)
    for a, b in [*sorted(regions), (len(x), len(x))]:
        part = x[at:a].copy()
        n = min(fade, len(part) // 2)
        if n and at:
            part[:n] *= np.linspace(0, 1, n)
        if n and a < len(x):
            part[-n:] *= np.linspace(1, 0, n)
        out.append(part)
        at = max(at, b)
    return np.concatenate(out)


def mend_one(x: np.ndarray, declip: bool = False, plosives: list | None = None, dehum: int | None = None, rate: int = RATE) -> np.ndarray:
    """Repairs of one signal, each if it is asked for; none at all is an error."""
    if not (declip or plosives is not None or dehum):
        raise ValueError("nothing to mend: ask for declip, plosives or dehum")
    if declip:
        x = K.declip(x)
    if plosives is not None and len(plosives):
        x = deplosive(x, [tuple(p) for p in plosives], rate)
    if dehum:
        x = K.apply_filter(x, *[K.notch(float(dehum * k), rate) for k in (1, 2, 3)])
    return np.asarray(x, float)


def mend(clips: DataFrame, declip: bool = False, plosives: str | None = None, dehum: int | None = None) -> DataFrame:
    """Clips repaired; plosives: a column of regions (arrays of first sample and end)."""
    if not (declip or plosives or dehum):
        raise ValueError("nothing to mend: ask for declip, plosives or dehum")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            regions = batch[plosives] if plosives else [None] * len(batch)
            done = [mend_one(np.asarray(x, float), declip, [] if plosives and r is None else r, dehum).astype(np.float32) for x, r in zip(batch["samples"], regions)]
            yield batch.assign(samples=done)

    return clips.mapInPandas(run, clips.schema)


def quieten(x: np.ndarray, breaths: list[tuple[int, int]] | None = None, clicks: list[tuple[int, int]] | None = None, remove: bool = False, rate: int = RATE, db: float = -6.0) -> np.ndarray:
    """Breaths turned down or removed, clicks turned down, with fades of 5 ms; clicks first, while positions hold."""
    fade = rate // 200
    for a, b in [*(clicks or []), *([] if remove else breaths or [])]:
        x = K.gain_region(x, a, b, db, fade)
    return remove_regions(x, breaths or [], fade) if remove else np.asarray(x, float)


def _levels(x: np.ndarray, size: int) -> np.ndarray:
    frames = np.asarray(x, float)[: len(x) // size * size].reshape(-1, size)
    return 10 * np.log10(np.einsum("ij,ij->i", frames, frames) / size + 1e-12)


def speech_frames(clips: DataFrame, keys: list[str], rate: int = RATE, ms: int = 30, above: float = 9.0, floor: float = -50.0) -> DataFrame:
    """(keys, frame, level_db, active): frames of 30 ms, and whether their level stands well above the clip's quiet tenth."""
    size = rate * ms // 1000
    fn = F.pandas_udf(lambda s: s.map(lambda x: _levels(x, size)), ArrayType(DoubleType()))
    held = clips.filter(F.size("samples") >= size).select(*keys, F.posexplode(fn("samples")).alias("frame", "level_db"))
    quiet = F.percentile("level_db", 0.1).over(Window.partitionBy(*keys))
    return held.withColumn("active", F.col("level_db") > F.greatest(quiet + above, F.lit(floor)))


def measures(clips: DataFrame, keys: list[str], lufs: bool = False) -> DataFrame:
    """Short-term maximum, loudness range and true peak of each clip at RATE, beside what ``signal.measure`` gives; of that the loudness as well,
    if asked for, so that clips which are dear to make are made once. Samples may be packed."""
    names = ["short_term_max", "loudness_range", "true_peak_db", *(["lufs"] if lufs else [])]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for *key, samples in batch[[*keys, "samples"]].itertuples(index=False):
                x = K.unpacked(samples)
                st = short_term(x)
                rows.append((*key, float(st.max()) if len(st) else None, loudness_range(x), true_peak(x) if len(x) else None, *([K.loudness(x)] if lufs else [])))
            yield pd.DataFrame(rows, columns=[*keys, *names])

    schema = clips.select(*keys).schema
    for n in names:
        schema = schema.add(n, "double")
    return clips.select(*keys, "samples").mapInPandas(run, schema)


def provenance(**known: Column | str | int | float | None) -> Column:
    """What made a result, as a JSON text: only what is known."""
    fixed = {"cadence_version": "2", "device": "cpu", "sample_rate": RATE} | {k: v for k, v in known.items() if v is not None}
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fixed.items()]), {"ignoreNullFields": "true"})
