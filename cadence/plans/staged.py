"""Plans of stages: what would run, running it with a log, and the documents that describe an edit."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What presets of the mastering chain have in common, and where each differs (loudness target, high-pass in Hz, equaliser gains and thresholds in dB).
_PLAIN = {"lufs": -16.0, "highpass_hz": 70.0, "mud": 0.0, "boxiness": 0.0, "presence": 0.0, "air": 0.0, "comp_threshold": -24.0, "comp_ratio": 2.0, "deesser": False, "deesser_threshold": -8.0}
PRESETS = {
    "creator": _PLAIN | {"mud": -2.0},
    "youtube": _PLAIN | {"lufs": -14.0, "presence": 2.0, "air": 1.0, "comp_ratio": 2.5, "deesser": True},
    "podcast": _PLAIN | {"mud": -3.0, "presence": 1.0, "comp_ratio": 3.0, "deesser": True},
    "social": _PLAIN | {"lufs": -14.0, "air": 2.0, "comp_threshold": -22.0, "comp_ratio": 3.5, "deesser": True},
    "bad-room": _PLAIN | {"highpass_hz": 90.0, "mud": -4.0, "boxiness": -2.0},
}
CHAIN = ["dc_block", "highpass", "dehum", "eq", "deesser", "compressor", "limiter", "loudness"]


@dataclass
class Plan:
    """Named stages (name, DataFrame -> DataFrame), applied in order; ``log`` has a row for each that ran."""

    stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]
    log: list[dict] = field(default_factory=list)

    def describe(self) -> list[str]:
        """The plan as text; nothing runs."""
        return [f"{i}. {name}" for i, (name, _) in enumerate(self.stages, 1)]

    def run(self, df: DataFrame) -> DataFrame:
        """All stages, each written to the shared folder before the next begins, so that the log has its own time, rows and failure. The first
        that fails is logged and ends the run."""
        from cadence.pinning import pinned

        for name, stage in self.stages:
            began = time.perf_counter()
            try:
                df = pinned(stage(df))
            except Exception as e:
                self.log.append({"stage": name, "ok": False, "error": str(e).splitlines()[0], "rows": None, "seconds": time.perf_counter() - began})
                raise StageError(name, len(self.log), self.log) from e
            self.log.append({"stage": name, "ok": True, "error": None, "rows": df.count(), "seconds": time.perf_counter() - began})
        return df


class StageError(RuntimeError):
    """A plan that ended early: the stage that failed, and the log up to it."""

    def __init__(self, stage: str, number: int, log: list[dict]):
        super().__init__(f"stage {number} ({stage}) failed: {log[-1]['error']}")
        self.stage, self.log = stage, log


def resolve_preset(name: str | None) -> dict:
    name = name or "creator"
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


def chain(options: Column) -> Column:
    """Stages of the mastering chain for a struct of switches (dehum, no_eq, no_comp, no_limit, no_loudnorm); the de-esser goes with the equaliser."""
    off = lambda k: F.coalesce(options[k], F.lit(False))
    kept = {"dehum": options["dehum"].isNotNull(), "eq": ~off("no_eq"), "deesser": ~off("no_eq"), "compressor": ~off("no_comp"), "limiter": ~off("no_limit"), "loudness": ~off("no_loudnorm")}
    return F.array_compact(F.array(*[F.when(kept.get(s, F.lit(True)), F.lit(s)) for s in CHAIN]))


# Beats of a short clip by what a viewer should meet, with the shares and seconds that bound them.
def end_card(duration: Column) -> Column:
    """When the end card may start."""
    return F.greatest(F.lit(0.0), F.when(duration <= 10, duration - 0.8).when(duration <= 30, duration - 1.5).otherwise(duration - 2.0))


def bounded_duration(value: Column) -> Column:
    """Seconds of a brief: 20 where it says none; not positive fails."""
    d = F.coalesce(value, F.lit(20.0))
    return F.when(d <= 0, F.raise_error(F.lit("duration must be positive"))).otherwise(F.round(d, 3))


def timeline(duration: Column) -> Column:
    """Beats (start, end, beat) of a clip of that many seconds; beats without length are left out."""
    d = duration
    hook = F.least(F.lit(0.7), d)
    promise = F.least(F.lit(2.5), F.greatest(hook + 0.1, d * 0.18))
    short = F.greatest(promise, d - 1.0)
    proof = F.least(F.lit(8.0), F.greatest(promise + 0.5, d * 0.38))
    last = F.greatest(proof, end_card(d))
    beat = lambda a, b, name: F.struct(a.alias("start_s"), b.alias("end_s"), F.lit(name).alias("beat"))
    zero = F.lit(0.0)
    beats = (
        F.when(d <= 1, F.array(beat(zero, hook, "hook")))
        .when(d <= 8, F.array(beat(zero, hook, "hook"), beat(hook, promise, "promise"), beat(promise, short, "proof"), beat(short, d, "payoff")))
        .otherwise(F.array(beat(zero, hook, "hook"), beat(hook, promise, "promise"), beat(promise, proof, "proof"), beat(proof, last, "progression"), beat(last, d, "payoff_cta")))
    )
    return F.filter(beats, lambda b: b["end_s"] > b["start_s"])


def recommendations(clicks: Column, breaths: Column, plosives: Column, clipped: Column, hum: Column, reverb: Column, snr: Column, still: Column) -> Column:
    """What an inspection suggests, a rule each."""
    return F.array_compact(F.array(
        F.when(clicks >= 5, "declick"), F.when(breaths >= 3, "tame_breaths"), F.when(plosives >= 2, "deplosive"), F.when(clipped > 0.001, "declip"), F.when(hum > -45, "dehum"),
        F.when(reverb.isin("medium", "high"), "dereverb"), F.when(snr < 15, "enhance"), F.when(snr >= 15, "master_only"), F.when(still, "stationary_noise"),
    ))


def manifest(rows: DataFrame, name: str, size: str) -> DataFrame:
    """A short fingerprint of a set of named sizes, whatever their order."""
    line = F.concat_ws(":", F.col(name), F.col(size).cast("string"))
    return rows.select(line.alias("m")).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("m")), "\n"), 256), 1, 16).alias("fingerprint"))


# What each archetype of a clip needs, and where each platform differs.
ARCHETYPES = ["talking_head", "tutorial", "product", "story", "montage"]
BRIEF = ["platform", "objective", "archetype", "cta", "source_assets"]


def edit_spec(briefs: DataFrame) -> DataFrame:
    """Briefs with their resolved edit: archetype (talking_head if unknown), duration, switches, beats, end card and what is missing."""
    from cadence.functions import scalars as S

    d = bounded_duration(F.col("duration_s"))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "[]"), F.lit(c)) for c in BRIEF]))
    return briefs.select(
        S.platform(F.col("platform")).alias("platform"), "objective", F.when(F.col("archetype").isin(*ARCHETYPES), F.col("archetype")).otherwise(ARCHETYPES[0]).alias("archetype"),
        d.alias("duration_s"), *[S.as_bool(F.col(c), True).alias(c) for c in ("speech", "captions", "music")], timeline(d).alias("beats"), end_card(d).alias("end_card_s"), missing.alias("missing"),
    )


def rule_plan(words: DataFrame, keys: list[str], most: float = 60.0, level: str = "medium") -> DataFrame:
    """The plain plan of a clip from its words: cut silences, a riser that ends with the last word, captions."""
    last = words.groupBy(*keys).agg(F.round(F.max_by("e", "pos"), 2).alias("hit"))
    effect = F.struct(F.lit("audio riser").alias("cmd"), F.create_map(F.lit("hit"), F.col("hit").cast("string")).alias("args"))
    return last.select(*keys, F.lit(1).alias("version"), F.lit(level).alias("level"), F.array(effect).alias("effects"), F.lit(most).alias("max_dur"), F.lit(18).alias("crf"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Where two plans of the same clips differ: keys, column, both values."""
    held = a.select(*keys, *[F.to_json(F.struct(c)).alias(f"__a_{c}") for c in columns]).join(b.select(*keys, *[F.to_json(F.struct(c)).alias(f"__b_{c}") for c in columns]), keys, "full")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__a_{c}").alias("a"), F.col(f"__b_{c}").alias("b")) for c in columns]))
    return held.select(*keys, rows.alias("r")).select(*keys, "r.*").filter("not (a <=> b)")
