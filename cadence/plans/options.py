"""Option records of effects: ranges and choices as one table, checked by one evaluator; defaults and placement."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.plans.rules import errors

class Range(NamedTuple):
    """Least and greatest value (None: no bound); above: the least itself is out."""

    low: float | None
    high: float | None
    above: bool = False


# The range, or the choices, of each option of each effect.
EASINGS = ("smooth", "out", "in", "linear")
RANGES = {
    "zoom": {
        "pct": Range(0, 200, above=True), "curve": Range(0, 100), "easing": EASINGS, "direction": ("grow", "shrink", "pulse"), "hold": Range(0, 0.9), "pulse_dur": Range(1, 30), "max_pulses": Range(1, 12), "ss": ("1", "2", "4"), "crf": Range(0, 51, above=True),
    },
    "magnify": {
        "size": Range(0.02, 0.5), "zoom": Range(1.05, 20), "feather": Range(0, 0.5), "ring_width": Range(0, 0.3), "motion": ("static", "scan", "voice", "auto"), "hold": Range(0.2, 20), "move_dur": Range(0.2, 8), "min_gap": Range(0.5, 15), "sharpen": Range(0, 2), "crf": Range(0, 51, above=True),
    },
    "levitate": {
        "at": Range(0, None), "lift": Range(0, 60), "dur": Range(0.05, 30), "bob": Range(0, 30), "motion": ("static", "float", "drift"), "move_x": Range(-100, 100), "move_y": Range(-100, 100), "rotate": Range(-180, 180), "scale": Range(-75, 300), "sway": Range(0, 30), "sway_period": Range(0.2, 30), "curve": Range(0, 100), "subject": ("auto", "person", "object"), "plate_samples": Range(2, 240), "feather": Range(0, 20), "shadow_strength": Range(0, 1), "crf": Range(0, 51, above=True),
    },
    "teleport": {
        "time": Range(0, None), "dilate": Range(0, 50), "plate_samples": Range(2, 240), "crf": Range(0, 51, above=True),
    },
    "stabilize": {
        "smoothing": Range(0, 120), "max_shift": Range(1, 1000), "max_angle": Range(0, 45), "crop": ("keep", "black"), "max_zoom": Range(1, 2), "crf": Range(0, 51, above=True),
    },
    "video": {
        "fps": Range(0, None, above=True), "outscale": ("1", "2", "3", "4"),
    },
    "cutsilence": {
        "level": ("light", "medium", "aggressive"), "keep": Range(0, None), "crf": Range(0, 51, above=True),
    },
    "lowpass": {
        "cutoff": Range(20, 20000), "transition": Range(0, 60), "curve": Range(0, 100), "easing": EASINGS, "order": ("1", "2", "4"), "resonance": Range(0.5, 2), "occlusion": Range(0, 12), "shelf": Range(50, 2000), "start": Range(0, None), "end": Range(0, None, above=True),
    },
    "transition": {
        "at": Range(0, None), "dur": Range(0.5, 30), "gain_db": Range(-60, 0), "curve": Range(0, 100), "easing": EASINGS,
    },
    "riser": {
        "dur": Range(0.5, 15), "style": ("notes", "glide"), "gain_db": Range(-60, 0), "tail": Range(0, 5),
    },
    "melody": {
        "start": Range(0, None), "bars": Range(1, 64), "bpm": Range(30, 300), "gain_db": Range(-60, 0), "duck_db": Range(0, 24),
    },
}


def wrong(value: Column, rule: Range | tuple[str, ...]) -> Column:
    """Whether a text value breaks a rule; a null value breaks none (the default holds)."""
    if not isinstance(rule, Range):
        return ~value.isin(*rule)
    number = value.try_cast("double")
    bad = number.isNull()
    if rule.low is not None:
        bad = bad | ((number <= rule.low) if rule.above else (number < rule.low))
    return bad | (number > rule.high) if rule.high is not None else bad


def violations(records: DataFrame, effect: str = "effect", options: str = "options") -> DataFrame:
    """Records (effect, options MAP<STRING,STRING>) with ``errors``: options out of range, then what two options must not be together."""
    v = lambda k: F.try_element_at(options, F.lit(k))
    n = lambda k: v(k).try_cast("double")
    is_ = lambda name: F.col(effect) == name
    rules = [(f"{name}.{key}", is_(name) & v(key).isNotNull() & wrong(v(key), rule)) for name, keys in RANGES.items() for key, rule in keys.items()]
    rules += [
        ("effect", ~F.col(effect).isin(*RANGES)), ("end not after start", n("end") <= n("start")), ("shrink to nothing", is_("zoom") & (v("direction") == "shrink") & (n("pct") >= 100)),
        ("resonance of a first-order filter", is_("lowpass") & (n("order") == 1) & v("resonance").isNotNull()), ("hit before it can rise", is_("riser") & (n("hit") < F.coalesce(n("dur"), F.lit(0.0)))),
    ]
    return records.withColumn("errors", errors(rules))


def segment(start: Column, end: Column, duration: Column) -> Column:
    """A segment kept within a clip: start, end and whether anything is left."""
    a, b = F.greatest(F.coalesce(start, F.lit(0.0)), F.lit(0.0)), F.least(F.coalesce(end, duration), duration)
    return F.struct(a.alias("start"), b.alias("end"), (a < b).alias("ok"))


def placement_errors(start: Column, end: Column, duration: Column) -> Column:
    """What is wrong with where a region lies in a clip."""
    return errors([("starts after the clip", start >= duration), ("ends after the clip", end > duration)])


def estimate_seconds(frames: Column, model: Column, height: Column) -> Column:
    """Seconds that an up-scaling takes, by the measured frames a second of a model and size class."""
    # Measured speeds for frames of up to 900 lines and above.
    speed = F.when(model == "x4plus", F.when(height <= 900, 0.12).otherwise(0.04)).otherwise(F.when(height <= 900, 0.85).otherwise(0.39))
    return frames / speed


def waypoints(cells: DataFrame, moments: DataFrame | None, keys: list[str], hold: float, move: float) -> DataFrame:
    """Grid cells in order with when each is visited: at the moments as far as they go, or one after the other."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("cell")
    if moments is not None:
        from cadence.operators.trajectory import zip_places

        return zip_places(cells, moments, keys, "cell", "at").drop("place")
    return cells.withColumn("at", (F.row_number().over(order) - 1) * (hold + move))


def quality(duration_in: Column, duration_out: Column, fps_in: Column, fps_out: Column, longest: Column) -> Column:
    """What a result does not keep of its source."""
    return errors([("length drifts", F.abs(duration_in - duration_out) > 0.3), ("frame rate drifts", F.abs(fps_in - fps_out) > 0.5), ("too long", duration_out > longest)])
