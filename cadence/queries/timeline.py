"""Queries of intervals, frames and trajectories over the events table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import frames as R
from cadence.operators import intervals as I  # noqa: E741
from cadence.operators import mastering as M
from cadence.operators import signal
from cadence.operators import trajectory as T
from cadence.session import table

HOUR = 3_600_000_000
r6 = lambda c: F.round(c, 6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``us``: microseconds of the epoch."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour from each event, merged per user."""
    e = events(spark, sf_dir).select("user_id", F.col("us").alias("start"), (F.col("us") + HOUR).alias("end"))
    return I.merge(e, ["user_id"])


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", F.col("us").alias("start"), F.col("us").alias("end"))
    return I.merge(I.expand(e, 2 * HOUR, HOUR), ["user_id"])


def gap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = I.trim(spans(spark, sf_dir), ["user_id"], 8 * HOUR, 3 * HOUR)
    return parts.groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("kept_us"))


def keep_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.keep_parts(spans(spark, sf_dir), ["user_id"], 8 * HOUR, 3 * HOUR).select("user_id", "start", "end")


def cut_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cuts(I.keep_parts(spans(spark, sf_dir), ["user_id"], 8 * HOUR, 3 * HOUR), ["user_id"])


def activity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = events(spark, sf_dir).select("event_type", F.floor(F.col("us") / HOUR).cast("long").alias("hour"))
    return I.consecutive(hours, ["event_type"], "hour").filter("length >= 3")


def flag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events above a user's interpolated upper quartile less 12."""
    e = R.active(events(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], "value")
    return I.runs(e, ["user_id"], "event_id", F.col("active")).filter("length > 1")


def quantize_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.quantize(spans(spark, sf_dir), ["user_id"], 1 / HOUR).select("user_id", "start", "end")


def packed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases on the timeline that only has the kept parts."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "event_id", "us")
    return I.inside(e, I.keep_parts(spans(spark, sf_dir), ["user_id"], 8 * HOUR, 3 * HOUR), ["user_id"], "us").select("event_id", "packed")


def overlap_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    own = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("us").alias("start"), (F.col("us") + HOUR).alias("end"))
    busy = e.filter("event_type = 'error'").select("user_id", (F.col("us") - HOUR // 2).alias("start"), (F.col("us") + HOUR // 2).alias("end"))
    return I.reject_overlaps(own, busy, ["user_id"], HOUR // 3).select("event_id")


def overlap_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    own = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("us").alias("start"), (F.col("us") + HOUR).alias("end"))
    busy = e.filter("event_type = 'error'").select("user_id", (F.col("us") - HOUR // 2).alias("start"), (F.col("us") + HOUR // 2).alias("end"))
    return I.overlap_notes(own, busy, ["user_id"], HOUR // 3).select("event_id", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def gain_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of frames of eight samples, from events, at every sample."""
    e = table(spark, sf_dir, "events").withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    g = M.spread_gains(e, ["user_id"], "frame", "value", 8)
    return g.select("user_id", "sample", r6("gain").alias("gain"))


def clips(spark: SparkSession, sf_dir: str, packed: bool = False) -> DataFrame:
    """A tone burst for each user: 1.5 s at the events' number and mean value, quiet for its last third; samples packed if asked for."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    # a row here is small and its clip is not: without a number of their own these partitions are joined to one
    u = u.repartition(max(200, 4 * spark.sparkContext.defaultParallelism), "user_id")
    return u.mapInPandas(lambda batches: _bursts(batches, packed), f"user_id long, samples {'binary' if packed else 'array<float>'}")


def _bursts(batches: Iterator, packed: bool) -> Iterator:
    at, loud = np.arange(72_000.0), 48_000
    for batch in batches:
        for start in range(0, len(batch), 32):  # a clip is 300 kB
            own = batch.iloc[start : start + 32]
            level, made = np.fmin(0.9, 0.05 + own["v"].astype(float) / 200), []
            for n, top in zip(own["n"], level):
                x = np.sin(at * (100.0 + n * 40) * (6.283185307179586 / 48_000))
                x[:loud] *= top
                x[loud:] *= top / 200
                made.append(signal.packed(x) if packed else x.astype(np.float32))
            yield own[["user_id"]].assign(samples=made)


def speech_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.speech_frames(clips(spark, sf_dir), ["user_id"])
    return f.groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if("active").alias("active"))


def mastered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The podcast chain over a burst for each user: loudness and true peak afterwards."""
    done = M.measures(M.master(clips(spark, sf_dir, packed=True), "podcast"), ["user_id"], lufs=True)
    return done.select("user_id", F.round("lufs", 2).alias("lufs"), (F.col("true_peak_db") <= -0.99).alias("below_peak"))


def greedy_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.spaced(events(spark, sf_dir), ["user_id"], "us", "value", 24 * HOUR, 3).select("user_id", "us", "value")


def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.levels(table(spark, sf_dir, "events"), [], "event_id", "value", 50)
    return f.select("frame", r6("level_db").alias("level_db"), "peak", r6("crest_db").alias("crest_db"))


def snr_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.ratio_split(table(spark, sf_dir, "events"), ["user_id"], "value", F.col("event_type").isin("view", "click"))
    return f.select("user_id", r6("snr_db").alias("snr_db"), r6("confidence").alias("confidence"))


def rolling_median_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.rolling_median(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value", 5)
    return e.filter("value > 4 * median").select("event_id", r6("median").alias("median"))


def moving_avg_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.moving_average(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 6)
    e = e.withColumn("smooth", r6("smooth"))
    return R.emphasis(e, ["user_id"], "event_id", "smooth").select("user_id", "first", "last", "peak", F.round("centre", 3).alias("centre"))


def decay_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("x", F.row_number().over(order).cast("double"))
    f = R.decay(e, ["user_id"], "x", "value")
    return f.select("user_id", "n", r6("slope").alias("slope"), r6("r2").alias("r2"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("dev"), F.max(v).alias("top"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("seen"))


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stats(spark, sf_dir)
    parts = {
        "noise": R.noise_score(F.col("mean") / 4), "clarity": R.clarity_score(F.col("seen") / F.col("n")), "loudness": R.loudness_score(-F.col("mean") / 3),
        "room": R.room_score(F.col("errors") / 20.0, F.lit(0.5)), "dynamics": R.dynamics_score(F.when(F.col("user_id") % 2 == 0, F.col("dev") / 6), F.col("top") / 30),
    }
    total = R.composite(parts)
    return s.select("user_id", F.round(total, 4).alias("score"), R.verdict(total).alias("verdict"))


def noise_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stats(spark, sf_dir)
    kind = R.noise_kind(F.col("top") > 400, F.col("top") > 6 * F.col("mean"), R.stationary(F.col("mean"), F.col("dev") / 3, F.col("n")), F.col("seen") > 13, F.col("errors") > 13, F.col("seen") / F.col("n"), F.col("errors"))
    return s.select("user_id", kind.alias("kind"))


KEYFRAMES = "0:0,0;0.25:10,-20,5;0.6=40,30,-15,120;1:0,0,0,100"


def keyframe_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = spark.range(1).select(F.explode(T.parse_keyframes(F.lit(KEYFRAMES))).alias("k")).select("k.*")
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 1201) / 1000.0 - 0.1).alias("p"))
    return T.interpolate(e, track, "p").select("event_id", *[r6(c).alias(c) for c in T.POSE])


def ease_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 201) / 160.0 - 0.1).alias("p"))
    return p.select("event_id", *[r6(S.ease(F.col("p"), 40.0, k)).alias(k) for k in ("linear", "in", "out", "smooth")])


def phase_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 60).alias("frame"))
    return f.select("event_id", T.phase(F.col("frame"), F.lit(10), F.lit(60), 4, 7, 5).alias("shift"), T.phase(F.col("frame"), F.lit(10), F.lit(60), 4, 7, 5, True).alias("vanish"))


def zoom_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 101 / 20.0).alias("t"))
    return t.select("event_id", *[r6(T.zoom(F.col("t"), F.lit(4.0), direction=d)).alias(d) for d in ("grow", "pulse", "shrink")])


def path_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100 - 5000).cast("long").alias("dx"))
    return T.accumulate(e, ["user_id"], "event_id", ["dx"]).select("event_id", "path_dx")


def shake_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.residual(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 1.5)
    return s.select("user_id", r6("median").alias("median"), r6("deviation").alias("deviation"))


def kernel_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("place"), "value")
    return T.smooth(e, ["user_id"], "place", "value", 2.0).select("user_id", "place", r6("smooth").alias("smooth"))


def mask_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    fine = e.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("event_id") * 4 + k)).alias("at"))  # a quarter lies beyond the mask
    return R.align(fine, e.select(F.col("event_id").alias("at"), (F.col("value") > 50).alias("flag")), [], "at", "flag", 3)


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return T.zip_places(e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("a")), e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("b")), ["user_id"], "a", "b")


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_paid"))
    return T.carry(e, ["user_id"], "event_id", "last_paid").select("event_id", "last_paid")


def timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "events")  # noqa: E741
    t = F.col("event_id") * 7 + F.col("event_id") % 100 / 100.0
    return l.select("event_id", S.timecode(t).alias("shown"))


def tempo_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 40 + 1) / 20.0).alias("f"))
    chain = S.atempo_chain(F.col("f"))
    return f.select("event_id", F.size(chain).alias("stages"), r6(F.try_element_at(chain, F.lit(1))).alias("each"))


def note_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 88 + 21).alias("midi"))
    return e.select("event_id", S.midi_to_name(F.col("midi")).alias("name"), r6(S.midi_to_freq(F.col("midi"))).alias("hz"))


def similarity_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100 + 0.5).alias("a"), (F.col("event_id") % 7 / 10.0).alias("b"), F.col("value").alias("tx"), (F.col("event_id") % 11 * 1.0).alias("ty"))
    i = T.invert(*[F.col(c) for c in ("a", "b", "tx", "ty")])
    d = T.decompose(*[F.col(c) for c in ("a", "b", "tx", "ty")])
    return e.select("event_id", r6(i["a"]).alias("ia"), r6(i["b"]).alias("ib"), F.round(i["tx"], 5).alias("itx"), F.round(i["ty"], 5).alias("ity"), r6(d["scale"]).alias("scale"), r6(d["angle"]).alias("angle"))


def wet_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 200 / 20.0).alias("t"))
    return t.select("event_id", r6(T.envelope(F.col("t"), 2.0, 8.0, 1.5)).alias("wet"), r6(T.lift(F.col("t"), 1.0, 80.0, 2.0, 5.0)).alias("lift"))


def frame_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of three bins of frames of 50 events."""
    p = signal.spectrum(table(spark, sf_dir, "events"), [], "event_id", "value", 50, [1, 5, 12])
    return p.select("frame", *[F.round(f"p{k}", 5).alias(f"p{k}") for k in (1, 5, 12)])


def chord_voicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event a major triad, voiced as near as can be to the minor triad on A3."""
    r = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 24 + 48).cast("int").alias("root"))
    return r.select("event_id", "root", F.array_join(S.voice_leading(S.triad(F.lit(57), "minor"), S.triad(F.col("root"), "major")), ",").alias("notes"))


def similarity_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered products of inverse similarities along each user's events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.lit(1.0) + (F.col("event_id") % 7 - 3) / 200.0).alias("a"), ((F.col("event_id") % 5 - 2) / 100.0).alias("b"), (F.col("value") / 100).alias("tx"), (F.col("event_id") % 3 * 1.0).alias("ty"))
    return T.accumulate_similarity(e, ["user_id"], "event_id").select("event_id", *[F.round(c, 5).alias(c) for c in ("pa", "pb", "px", "py")])


QUERIES = {f.__name__: f for f in (interval_merge, gap_trim, keep_parts, cut_count, activity_runs, flag_runs, quantize_spans, packed_points, overlap_reject, overlap_notes, gain_spread, speech_levels, mastered, greedy_spacing, frame_rms, snr_split, rolling_median_spikes, moving_avg_peaks, decay_fit, composite_score, noise_class, keyframe_lerp, ease_curves, phase_schedule, zoom_curve, path_accumulate, shake_stats, kernel_smooth, mask_align, positional_zip, carry_forward, timecode, tempo_chains, note_table, similarity_inverse, wet_envelope, frame_spectrum, chord_voicing, similarity_path)}

_MERGE = """{name} as (select user_id, min(s) as s, max(e) as e from (select *, sum(fresh) over (partition by user_id order by s, e rows unbounded preceding) as g
  from (select *, case when s > max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 1 when row_number() over (partition by user_id order by s, e) = 1 then 1 else 0 end as fresh from {source})) group by user_id, g)"""
_SPANS = f"ev as (select *, epoch_us(ts) as us from events), raw as (select user_id, us as s, us + {HOUR} as e from ev), " + _MERGE.format(name="sp", source="raw")
_TRIM = _SPANS + f""", ga as (select user_id, lag(e) over (partition by user_id order by s) as s, s as e from sp), tr as (
  select user_id, s, e, 'span' as kind from sp union all select user_id, s, case when e - s > {8 * HOUR} then s + {3 * HOUR} else e end, 'gap' from ga where e > s)"""
_KEEP = _TRIM + ", " + _MERGE.format(name="kp", source="tr")
_EASE = "case when {p} is null then null else pow({p}, 1 + {c} / 25.0) / (pow({p}, 1 + {c} / 25.0) + pow(1 - {p}, 1 + {c} / 25.0)) end"


def _ease(p: str, c: float = 50.0) -> str:
    return _EASE.format(p=f"least(greatest({p}, 0.0), 1.0)", c=c)


def _zoom(kind: str) -> str:
    a, b, c = (1.2, 1.6, 1.2) if kind == "pulse" else (4.0, 0.0, 0.001)
    return f"round(1 {'-' if kind == 'shrink' else '+'} 0.2 * ({_ease(f't / {a}')}) * ({_ease(f'({a} + {b} + {c} - t) / {c}')}), 6) as {kind}"


def _phase(name: str, vanish: bool) -> str:
    half, late = (7, "'empty'") if vanish else (3, None)
    return f"case when frame < 10 then null when frame < 14 then 'white_a' when frame < {14 + half} then 'empty' when frame < 21 then {late or chr(39) + 'appear' + chr(39)} when frame < 26 then {late or chr(39) + 'white_b' + chr(39)} else {late or chr(39) + 'after' + chr(39)} end as {name}"


_STATS = "st as (select user_id, count(*) as n, avg(value) as mean, stddev_pop(value) as dev, max(value) as top, count(*) filter (where event_type = 'error') as errors, count(*) filter (where event_type = 'view') as seen from events group by user_id)"
_TAPS = ", ".join(f"({k}, {2.718281828459045 ** (-0.5 * (k / 2.0) ** 2) / sum(2.718281828459045 ** (-0.5 * (j / 2.0) ** 2) for j in range(-8, 9))!r})" for k in range(-8, 9))

ORACLES = {
    "interval_merge": "with ev as (select *, epoch_us(ts) as us from events), raw as (select user_id, us - " + f"{2 * HOUR} as s, us + {HOUR} as e from ev), x as (select *, case when s > max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 1 when row_number() over (partition by user_id order by s, e) = 1 then 1 else 0 end as fresh from raw), y as (select *, sum(fresh) over (partition by user_id order by s, e rows unbounded preceding) as g from x) select user_id, min(s) as start, max(e) as \"end\", count(*) as spans from y group by user_id, g",
    "gap_trim": f"with {_TRIM} select user_id, kind, count(*) as n, cast(sum(e - s) as bigint) as kept_us from tr group by 1, 2",
    "keep_parts": f'with {_KEEP} select user_id, s as start, e as "end" from kp',
    "cut_count": f"with {_KEEP}, c as (select *, case when s > lag(e) over (partition by user_id order by s) then 1 else 0 end as cut from kp) select user_id, cast(sum(cut) as bigint) as cuts, count(*) as parts, cast(sum(e - s) as bigint) as kept from c group by 1",
    "activity_runs": f"with h as (select distinct event_type, epoch_us(ts) // {HOUR} as hour from events), g as (select *, hour - row_number() over (partition by event_type order by hour) as g from h) select event_type, min(hour) as first, max(hour) as last, count(*) as length from g group by event_type, g having count(*) >= 3",
    "flag_runs": "with l as (select user_id, greatest(-50.0, quantile_cont(value, 0.75) - 12) as lim from events group by 1), f as (select e.user_id, event_id, value > lim as on_ from events e join l using (user_id)), g as (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, on_ order by event_id) as g from f) select user_id, min(event_id) as first, max(event_id) as last, count(*) as length from g where on_ group by user_id, g having count(*) > 1",
    "quantize_spans": f"with {_SPANS}, q as (select user_id, cast(round_even(s * {1 / HOUR!r}, 0) as bigint) as s, cast(round_even(e * {1 / HOUR!r}, 0) as bigint) as e from sp), qf as (select * from q where e > s), " + _MERGE.format(name="qm", source="qf") + ' select user_id, s as start, e as "end" from qm',
    "packed_points": f"with {_KEEP}, sh as (select *, coalesce(sum(e - s) over (partition by user_id order by s rows between unbounded preceding and 1 preceding), 0) - s as shift from kp) select event_id, cast(us + shift as bigint) as packed from ev join sh using (user_id) where event_type = 'purchase' and us >= s and us < e",
    "overlap_reject": f"with ev as (select *, epoch_us(ts) as us from events) select event_id from ev a where event_type = 'purchase' and not exists (select 1 from ev b where b.user_id = a.user_id and b.event_type = 'error' and least(a.us + {HOUR}, b.us + {HOUR // 2}) - greatest(a.us, b.us - {HOUR // 2}) > {HOUR // 3})",
    "frame_rms": "with f as (select event_id // 50 as frame, count(*) as n, sqrt(avg(value * value)) as rms, max(abs(value)) as peak from events group by 1) select frame, round(20 * log10(rms + 1e-12), 6) as level_db, peak, round(20 * log10(peak / rms), 6) as crest_db from f where n = 50",
    "snr_split": "with f as (select user_id, avg(value * value) filter (where event_type in ('view', 'click')) as s, avg(value * value) filter (where event_type not in ('view', 'click')) as n, avg(case when event_type in ('view', 'click') then 1.0 else 0 end) as share from events group by 1) select user_id, round(least(greatest(10 * log10(s / nullif(n, 0)), -10), 40), 6) as snr_db, case when s / nullif(n, 0) is not null then round(least(0.3 + share, 0.95), 6) end as confidence from f",
    "rolling_median_spikes": "with m as (select event_id, value, median(value) over (partition by event_type order by event_id rows between 5 preceding and 5 following) as med from events) select event_id, round(med, 6) as median from m where value > 4 * med",
    "overlap_notes": f"with ev as (select *, epoch_us(ts) as us from events), o as (select a.event_id, max(least(a.us + {HOUR}, b.us + {HOUR // 2}) - greatest(a.us, b.us - {HOUR // 2})) as overlap from ev a join ev b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'error' and least(a.us + {HOUR}, b.us + {HOUR // 2}) - greatest(a.us, b.us - {HOUR // 2}) > {HOUR // 3} group by 1) select event_id, cast(coalesce(overlap, 0) as bigint) as overlap from ev left join o using (event_id) where event_type = 'purchase'",
    "gain_spread": "with f as (select user_id, value as g, row_number() over w - 1 as frame, lag(value) over w as b, lead(value) over w as a from events window w as (partition by user_id order by event_id)), s as (select *, unnest(range(8)) as k from f) select user_id, cast(frame * 8 + k as bigint) as sample, round(case when k < 4 then g + (4 - k) / 8.0::double * (coalesce(b, g) - g) else g + (k - 4) / 8.0::double * (coalesce(a, g) - g) end, 6) as gain from s",
    "speech_levels": "with u as (select user_id, count(*) as n from events group by 1) select user_id, cast(50 as bigint) as frames, cast(34 as bigint) as active from u",
    "greedy_spacing": f"with recursive x as (select user_id, epoch_us(ts) as us, value, row_number() over (partition by user_id order by value desc, epoch_us(ts) desc) as n from events), r as (select user_id, us, value, n, 1 as k, [us] as chosen from x where n = 1 union all select user_id, us, value, n, k, chosen from (select x.user_id, x.us, x.value, x.n, r.k + 1 as k, list_append(r.chosen, x.us) as chosen, row_number() over (partition by x.user_id order by x.n) as f from r join x on x.user_id = r.user_id and x.n > r.n and r.k < 3 and list_min(list_transform(r.chosen, lambda c: abs(c - x.us))) >= {24 * HOUR}) where f = 1) select user_id, us, value from r",
    "similarity_path": "with recursive e as (select user_id, event_id, 1.0::double + (event_id % 7 - 3) / 200.0::double as a, (event_id % 5 - 2) / 100.0::double as b, value / 100 as tx, (event_id % 3)::double as ty, row_number() over (partition by user_id order by event_id) as n from events), i as (select user_id, event_id, n, a / (a * a + b * b) as a, -b / (a * a + b * b) as b, -(a * tx + b * ty) / (a * a + b * b) as tx, (b * tx - a * ty) / (a * a + b * b) as ty from e), p as (select user_id, event_id, n, a as pa, b as pb, tx as px, ty as py from i where n = 1 union all select i.user_id, i.event_id, i.n, p.pa * i.a - p.pb * i.b, p.pa * i.b + p.pb * i.a, p.px + p.pa * i.tx - p.pb * i.ty, p.py + p.pb * i.tx + p.pa * i.ty from p join i on i.user_id = p.user_id and i.n = p.n + 1) select event_id, round(pa, 5) + 0.0::double as pa, round(pb, 5) + 0.0::double as pb, round(px, 5) + 0.0::double as px, round(py, 5) + 0.0::double as py from p",
    "moving_avg_peaks": "with s as (select user_id, event_id, round(sum(value) over (partition by user_id order by event_id rows between 3 preceding and 2 following) / 6, 6) as sm from events), l as (select user_id, greatest(avg(sm) * 1.2, max(sm) * 0.35) as lim from s group by 1), f as (select s.*, lim, sm > lim as on_ from s join l using (user_id)), g as (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, on_ order by event_id) as g from f) select user_id, min(event_id) as first, max(event_id) as last, max(sm) as peak, round(sum((sm - lim) * event_id) / sum(sm - lim), 3) as centre from g where on_ group by user_id, g",
    "decay_fit": "with x as (select user_id, value, cast(row_number() over (partition by user_id order by event_id) as double) as x from events), f as (select user_id, count(*) as n, regr_slope(value, x) as slope, regr_r2(value, x) as r2 from x group by 1) select user_id, n, round(slope, 6) as slope, round(r2, 6) as r2 from f where n >= 5 and slope < 0",
    "composite_score": f"with {_STATS}, p as (select user_id, least(greatest(30 + 3 * (mean / 4), 0), 100) as a, least(greatest(100 * (seen / n), 0), 100) as b, least(greatest(100 - 5 * abs(-mean / 3 + 14), 0), 100) as c, errors / 20.0 as rt, case when user_id % 2 = 0 then 100 - least(50, 8 * abs(dev / 6 - 8)) end as d1, 100 - least(50, 3 * abs(top / 30 - 11)) as d2 from st), q as (select *, least(greatest(60 * (1 - case when rt > 2 then 0.15 else 0.5 end) + (100 - least(70, greatest(0, (least(rt, 2) - 0.25) * 150))) * case when rt > 2 then 0.15 else 0.5 end, 0), 100) as e, least(greatest(case when d1 is null then d2 else (d1 + d2) / 2 end, 0), 100) as f from p), t as (select user_id, round(a, 1) * 0.25 + round(b, 1) * 0.25 + round(c, 1) * 0.2 + round(e, 1) * 0.15 + round(f, 1) * 0.15 as t from q) select user_id, round(t, 4) as score, case when t >= 80 then 'good' when t >= 60 then 'fair' else 'poor' end as verdict from t",
    "noise_class": f"with {_STATS}, b as (select user_id, top > 400 as hum, top > 6 * mean as tonal, n > 4 and dev / 3 / (abs(mean) + 1e-9) < 0.35 as still, seen > 13 as broad, errors > 13 as rumble, 1.0 * seen / n as speech, errors from st) select user_id, case when hum then 'hum' when tonal and still then 'fan' when broad and still and rumble then 'ac' when broad and still then 'hiss' when speech < 0.1 and errors >= 8 then 'keyboard' when not still and broad and rumble then 'traffic' when not still and speech > 0.5 then 'people' when not still and tonal then 'music' when not still then 'non-stationary' when still then 'stationary' else 'unknown' end as kind from b",
    "keyframe_lerp": "with k(a, b, x0, x1, y0, y1, r0, r1, s0, s1) as (values (0.0, 0.25, 0.0, 10.0, 0.0, -20.0, 0.0, 5.0, 100.0, 100.0), (0.25, 0.6, 10.0, 40.0, -20.0, 30.0, 5.0, -15.0, 100.0, 120.0), (0.6, 1.0, 40.0, 0.0, 30.0, 0.0, -15.0, 0.0, 120.0, 100.0)), e as (select event_id, least(greatest((event_id % 1201)::double / 1000.0 - 0.1, 0), 1) as p from events) select event_id, round(x0 + (x1 - x0) * ((p - a) / (b - a)), 6) as x, round(y0 + (y1 - y0) * ((p - a) / (b - a)), 6) as y, round(r0 + (r1 - r0) * ((p - a) / (b - a)), 6) as rotation, round(s0 + (s1 - s0) * ((p - a) / (b - a)), 6) as scale from e join (select a::double as a, b::double as b, x0::double x0, x1::double x1, y0::double y0, y1::double y1, r0::double r0, r1::double r1, s0::double s0, s1::double s1 from k) k on (p > a or (p <= 0 and a <= 0)) and p <= b",
    "ease_curves": "with t as (select event_id, least(greatest((event_id % 201) / 160.0::double - 0.1, 0), 1) as p from events) select event_id, round(p, 6) as linear, round(pow(p, 1.8), 6) as \"in\", round(1 - pow(1 - p, 1.8), 6) as out, round(pow(p, 2.6) / (pow(p, 2.6) + pow(1 - p, 2.6)), 6) as smooth from t",
    "phase_schedule": f"select event_id, {_phase('shift', False)}, {_phase('vanish', True)} from (select event_id, event_id % 60 as frame from events)",
    "zoom_curve": f"with t as (select event_id, event_id % 101 / 20.0::double as t from events) select event_id, {_zoom('grow')}, {_zoom('pulse')}, {_zoom('shrink')} from t",
    "path_accumulate": "select event_id, cast(sum(cast(round(value * 100 - 5000) as bigint)) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as path_dx from events",
    "shake_stats": "with d as (select user_id, (value - lag(value) over (partition by user_id order by event_id)) * 1.5 as d from events) select user_id, case when count(d) < 2 then 0 else round(median(d), 6) end as median, case when count(d) < 2 then 0 else round(stddev_pop(d), 6) end as deviation from d where d is not null group by 1",
    "kernel_smooth": f"with e as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as place, value from events), l as (select user_id, max(place) as last from e group by 1), t(k, w) as (values {_TAPS}) select e.user_id, e.place, round(sum(w * v.value), 6) as smooth from e join l using (user_id) cross join t join e v on v.user_id = e.user_id and v.place = least(greatest(e.place + k, 0), last) group by 1, 2",
    "mask_align": "select a.event_id * 4 + k.k as at, coalesce(b.value > 50, false) as flag from events a cross join range(4) k(k) left join events b on b.event_id = (a.event_id * 4 + k.k) // 3",
    "positional_zip": "with a as (select user_id, event_id as a, row_number() over (partition by user_id order by event_id) as place from events where event_type = 'view'), b as (select user_id, event_id as b, row_number() over (partition by user_id order by event_id) as place from events where event_type = 'click') select user_id, place, a, b from a join b using (user_id, place)",
    "carry_forward": "select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as last_paid from events",
    "timecode": "with t as (select event_id, event_id * 7 as s, event_id % 100 as c from events) select event_id, printf('%d:%02d:%02d.%02d', s // 3600, (s % 3600) // 60, s % 60, c) as shown from t",
    "tempo_chains": "with t as (select event_id, (event_id % 40 + 1) / 20.0::double as f from events), c as (select event_id, f, case when f = 1 then 0 when f >= 0.5 then 1 else cast(ceil(round(ln(f) / ln(0.5), 12)) as int) end as stages from t) select event_id, stages, case when stages = 0 then null when stages = 1 then round(f, 6) else round(pow(f, 1.0 / stages), 6) end as each from c",
    "note_table": "select event_id, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][i % 12 + 1] || cast(i // 12 - 1 as varchar) as name, round(440.0 * pow(2.0::double, (i - 69) / 12.0::double), 6) as hz from (select event_id, event_id % 88 + 21 as i from events)",
    "similarity_inverse": "with e as (select event_id, value / 100 + 0.5 as a, (event_id % 7) / 10.0::double as b, value as tx, (event_id % 11)::double as ty from events), d as (select *, a * a + b * b as d from e) select event_id, round(a / d, 6) as ia, round(-b / d, 6) as ib, round(-(a * tx + b * ty) / d, 5) as itx, round((b * tx - a * ty) / d, 5) as ity, round(sqrt(d), 6) as scale, round(degrees(atan2(b, a)), 6) as angle from d",
    "frame_spectrum": "with f as (select event_id // 50 as frame, event_id % 50 as i, value from events), s as (select frame, count(*) as n, " + ", ".join(f"sum(value * cos(2 * pi() * {k} / 50 * i)) as c{k}, sum(value * sin(2 * pi() * {k} / 50 * i)) as s{k}" for k in (1, 5, 12)) + " from f group by 1) select frame, " + ", ".join(f"round((c{k} * c{k} + s{k} * s{k}) / 2500, 5) as p{k}" for k in (1, 5, 12)) + " from s where n = 50",
    "chord_voicing": "with c as (with v as (select r as root, o, k, [r, r + 4, r + 7] as b from range(48, 72) t(r), range(-1, 2) u(o), range(3) w(k)), n as (select root, [b[k % 3 + 1] + 12 * o + case when k >= 3 then 12 else 0 end, b[(k + 1) % 3 + 1] + 12 * o + case when k + 1 >= 3 then 12 else 0 end, b[(k + 2) % 3 + 1] + 12 * o + case when k + 2 >= 3 then 12 else 0 end] as x from v), d as (select root, x, abs(x[1] - 57) + abs(x[2] - 60) + abs(x[3] - 64) as total, greatest(abs(x[1] - 57), abs(x[2] - 60), abs(x[3] - 64)) as most from n) select root::int as root, x[1] || ',' || x[2] || ',' || x[3] as notes from d qualify row_number() over (partition by root order by total, most, x) = 1) select event_id, root, notes from (select event_id, event_id % 24 + 48 as root from events) join c using (root)",
    "wet_envelope": f"with t as (select event_id, event_id % 200 / 20.0::double as t from events) select event_id, round(case when t < 2 or t > 8 then 0 else least({_ease('(t - 2) / 1.5')}, {_ease('(8 - t) / 1.5')}) end, 6) as wet, round(case when t <= 1 then 0 else 80 * ({_ease('(t - 1) / 2')}) + case when t > 3 then 5 * sin(2 * pi() * (t - 3) / 2) else 0 end end, 6) as lift from t",
}
