"""Queries of recordings: the vectors of a label, one after another, are its recording, a block each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.operators import blocks as B
from cadence.operators import mastering as M
from cadence.operators import signal as K
from cadence.operators import tones
from cadence.session import table
from cadence.sources import recordings
from cadence.streaming import events as E

#: Samples of a block, and the rate that the recordings are taken to have.
SIZE, RATE = 64, 160
SECTIONS = (K.highpass(4.0, RATE), K.peaking(20.0, RATE, 1.0, 3.0), K.notch(50.0, RATE))
r6 = lambda c: F.round(c, 6)


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, block, samples); every fifth block is quiet."""
    order = Window.partitionBy("label").orderBy("vec_id")
    held = table(spark, sf_dir, "embeddings").withColumn("block", (F.row_number().over(order) - 1).cast("long"))
    quiet = F.when(F.col("block") % 5 == 4, 0.02).otherwise(1.0)
    return held.select("label", "block", F.transform("embedding", lambda v: F.least(F.greatest(v.cast("double"), F.lit(-4.0)), F.lit(4.0)) / 4 * quiet).alias("samples"))


def block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample after three recursive sections, whose state goes through all blocks."""
    out = B.uncut(B.filtered(recording(spark, sf_dir), ["label"], *SECTIONS), ["label"], SIZE)
    return out.select("label", F.col("at").alias("place"), r6("value").alias("value"))


def block_follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels as gains, smoothed over each recording."""
    gains = recording(spark, sf_dir).withColumn("samples", F.transform("samples", lambda v: F.abs(v)))
    out = B.uncut(B.followed(gains, ["label"], 0.3, 0.04), ["label"], SIZE)
    return out.select("label", F.col("at").alias("place"), r6("value").alias("value"))


def gated_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrated loudness, loudest three seconds and range, from energies of a tenth of a second."""
    parts = B.energies(recording(spark, sf_dir), ["label"], SIZE, RATE // 10)
    spread = B.loudness_range(parts, ["label"], RATE // 10)
    out = B.integrated(parts, ["label"], RATE // 10).join(spread, "label", "left")
    return out.select("label", r6("lufs").alias("lufs"), r6("short_term_max").alias("short_term_max"), r6("range").alias("range"))


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample at 220.5 instead of 160 a second."""
    out = B.resampled(recording(spark, sf_dir), ["label"], SIZE, 16_000, 22_050, 4)
    order = Window.partitionBy("label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = out.withColumn("__at", F.coalesce(F.sum(F.size("samples")).over(order), F.lit(0)))
    return held.select("label", "__at", F.posexplode("samples").alias("k", "v")).select("label", (F.col("__at") + F.col("k")).alias("place"), r6("v").alias("value"))


def true_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest level between the samples."""
    return B.peaks(recording(spark, sf_dir), ["label"], SIZE, 160).select("label", r6("true_peak_db").alias("true_peak_db"))


def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings as files of 24 bits, read back from the fourth block on: the filter is the source's, which opens no range before it."""
    recordings.register(spark)
    folder = E.scratch(spark, "wav")
    held = recording(spark, sf_dir).select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("path"), "block", "samples")
    held.repartition("path").sortWithinPartitions("path", "block").write.format("wav").options(path=folder, rate=16_000).mode("append").save()
    back = spark.read.format("wav").options(path=folder, block=SIZE).load().filter("block >= 3")
    whole = F.aggregate("samples", F.lit(0).cast("long"), lambda s, v: s + F.rint(v * 2**23).cast("long"))
    top = F.aggregate("samples", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))
    label = F.regexp_extract("path", "label(-?[0-9]+)[.]wav$", 1).cast("int")
    return back.groupBy(label.alias("label"), F.col("label").alias("bits"), "frames", "rate").agg(F.count("*").alias("blocks"), F.sum(whole).alias("total"), r6(F.max(top)).alias("peak"))


def catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of some sizes and one kind, found by the catalogue source itself."""
    recordings.register(spark)
    parts = spark.read.format("catalogue").option("path", f"{sf_dir}/part.parquet").load()
    return parts.filter("p_size >= 10 and p_size < 20 and p_type = 'ECONOMY' and p_name like '%ring%'").select("p_partkey", "p_name", "p_size")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for risers and melodies: some name their hit, tail or tempo, others leave it open."""
    n = F.col("event_id")
    mood = F.element_at(F.array(*[F.lit(m) for m in tones.MOODS]), (n % len(tones.MOODS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", mood.alias("mood"), F.when(n % 3 == 0, 2.0 + n % 5).alias("hit"), F.when(n % 2 == 0, (n % 4) / 4.0).alias("tail"), F.when(n % 5 == 0, 60.0 + n % 90).alias("bpm"), F.when(n % 7 == 0, F.col("value") / 50).alias("start"), F.lit(None).cast("double").alias("end"), (8.0 + n % 30).alias("duration_s"))


def band_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a short clip: level, share that is clipped, level of two bands and flatness of its spectrum, hum that its bins can't tell."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)).cast("float")).alias("samples"))
    m = K.measure(e, ["vec_id"])
    return m.select("vec_id", *[F.round(c, 4).alias(c) for c in ("rms_db", "clip_ratio", "low_db", "mid_db", "high_db", "flatness_db", "h50")])


def provenance_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What made a result, as texts that leave out what is not known."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", M.provenance(seed=F.when(F.col("p_size") % 2 == 0, F.col("p_size")), preset=F.lower("p_type"), seconds=F.when(F.col("p_size") > 25, F.col("p_size") / 4)).alias("text"))


def tone_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests leave open, from the mood and the clip."""
    return tones.resolved(_requests(spark, sf_dir)).select("event_id", r6("hit").alias("hit"), r6("bpm").alias("bpm"), r6("segment_s").alias("segment_s"))


def riser_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of every request's riser."""
    r = tones.resolved(_requests(spark, sf_dir))
    notes = r.select("event_id", F.inline(tones.riser_rows(F.col("mood"), F.col("hit"), F.coalesce("tail", F.lit(0.0)))))
    return notes.groupBy("event_id").agg(F.count("*").alias("notes"), F.sum("midi").alias("pitches"), r6(F.max("t_on")).alias("last_on"), r6(F.sum("dur")).alias("sounding"))


QUERIES = {f.__name__: f for f in (block_filter, block_follower, gated_loudness, true_peaks, wav_round_trip, catalogue_scan, band_levels, provenance_texts, tone_options, riser_notes)} | {"resampled_tones": resampled}

_SAMPLES = """rec as (select label, row_number() over (partition by label order by vec_id) - 1 as block, embedding from embeddings),
flat as (select label, block, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as k from rec),
x as (select label, block * 64 + k as place, least(greatest(v, -4), 4) / 4 * case when block % 5 = 4 then 0.02::double else 1 end as v from flat)"""


def _filter() -> str:
    """Direct recursion: a row holds a sample's output and the two numbers each section hands on."""
    value, names, columns = "x.v", [], []
    for k, (b, a) in enumerate(SECTIONS):
        b, a = [float(v) for v in b], [float(v) for v in a]
        y = f"({b[0]!r}::double * {value} + r.p{k})"
        columns += [f"{b[1]!r}::double * {value} - {a[1]!r}::double * {y} + r.q{k} as p{k}", f"{b[2]!r}::double * {value} - {a[2]!r}::double * {y} as q{k}"]
        names += [f"p{k}", f"q{k}"]
        value = y
    zeros = ", ".join(f"0.0::double as {n}" for n in names)
    return f"with recursive {_SAMPLES}, r as (select distinct label, -1 as place, 0.0::double as y, {zeros} from x union all select x.label, x.place, {value} as y, {', '.join(columns)} from r join x on x.label = r.label and x.place = r.place + 1) select label, cast(place as bigint) as place, round(y, 6) as value from r where place >= 0"


def _resample(rate: int, to: int, zeros: int) -> str:
    """Each output from the inputs around it, weighed as the windowed sinc says."""
    scale = min(1.0, to / rate)
    half = -int(-zeros // scale)
    return f"""{_SAMPLES}, n as (select label, count(*) as n from x group by 1), o as (select label, unnest(range(cast(ceil(n * {to} / {rate}) as bigint))) as k from n),
p as (select label, k, k * {rate} // {to} as base, (k * {rate} % {to}) / {to}::double as part, unnest(range({-half}, {half + 1})) as j from o),
w as (select *, (case when j - part = 0 then 1 else sin(pi() * (j - part) * {scale!r}) / (pi() * (j - part) * {scale!r}) end) * (case when abs(j - part) <= {half} then 0.5 + 0.5 * cos(pi() * (j - part) / {half}) else 0 end) as w from p),
res as (select w.label, w.k, sum(w.w * coalesce(x.v, 0)) / sum(w.w) as y from w left join x on x.label = w.label and x.place = w.base + w.j group by 1, 2)"""


_PARTS = _SAMPLES + """, h as (select label, place // 16 as hop, sum(v * v) as e, count(*) as n from x group by 1, 2), hop as (select label, hop, e from h where n = 16),
win as (select label, hop, sum(e) over f as e4, count(*) over f as n4, sum(e) over t as e30, count(*) over t as n30 from hop window f as (partition by label order by hop rows between current row and 3 following), t as (partition by label order by hop rows between current row and 29 following)),
m as (select label, e4 / 64 as p, -0.691 + 10 * log10(e4 / 64 + 1e-30) as l from win where n4 = 4), s as (select label, e30 / 480 as p, -0.691 + 10 * log10(e30 / 480 + 1e-30) as l from win where n30 = 30),
mg as (select label, -0.691 + 10 * log10(avg(p) + 1e-30) - 10 as gate from m where l > -70 group by 1), sg as (select label, -0.691 + 10 * log10(avg(p) + 1e-30) - 20 as gate from s where l > -70 group by 1)"""

def _asked() -> str:
    """The requests, with each mood's tempo and the pitches of its scale."""
    moods = ", ".join(f"({k}, {m.bpm}::double, {[int(p) for p in tones.degrees(m, 2, 1)]})" for k, m in enumerate(tones.MOODS.values()))
    return f"with m(k, tempo, pitches) as (values {moods}), q as (select event_id, tempo, pitches, case when event_id % 3 = 0 then 2.0::double + event_id % 5 end as hit, case when event_id % 2 = 0 then (event_id % 4) / 4.0::double end as tail, case when event_id % 5 = 0 then 60.0::double + event_id % 90 end as bpm, case when event_id % 7 = 0 then value / 50 end as start, 8.0::double + event_id % 30 as duration_s from events join m on k = event_id % {len(tones.MOODS)})"


ORACLES = {
    "block_filter": _filter(),
    "block_follower": f"with recursive {_SAMPLES}, r as (select distinct label, -1 as place, 1.0::double as y from x union all select x.label, x.place, r.y + case when abs(x.v) < r.y then 0.3::double else 0.04::double end * (abs(x.v) - r.y) from r join x on x.label = r.label and x.place = r.place + 1) select label, cast(place as bigint) as place, round(y, 6) as value from r where place >= 0",
    "gated_loudness": f"with {_PARTS}, i as (select label, -0.691 + 10 * log10(avg(p) + 1e-30) as lufs from m join mg using (label) where l > -70 and l > gate group by 1), t as (select label, max(l) as top from s group by 1), g as (select label, quantile_cont(l, 0.95) - quantile_cont(l, 0.1) as spread from s join sg using (label) where l > -70 and l > gate group by 1) select label, round(lufs, 6) as lufs, round(top, 6) as short_term_max, round(spread, 6) as \"range\" from i left join t using (label) left join g using (label)",
    "resampled_tones": f"with {_resample(16_000, 22_050, 4)} select label, k as place, round(y, 6) as value from res",
    "true_peaks": f"with {_resample(160, 640, 16)} select label, round(20 * log10(max(abs(y)) + 1e-12), 6) as true_peak_db from res group by 1",
    "wav_round_trip": f"with {_SAMPLES}, q as (select label, place, least(greatest(round_even(v * 8388608, 0), -8388608), 8388607) as w from x) select label, 'PCM_24' as bits, any_value(f.n) as frames, 16000 as rate, count(distinct place // 64) as blocks, cast(sum(w) as bigint) as total, round(max(abs(w)) / 8388608, 6) as peak from q join (select label, count(*) as n from x group by 1) f using (label) where place >= 192 group by 1",
    "catalogue_scan": "select p_partkey, p_name, p_size from part where p_size >= 10 and p_size < 20 and p_type = 'ECONOMY' and p_name like '%ring%'",
    "tone_options": f"{_asked()} select event_id, round(coalesce(hit, duration_s - coalesce(tail, 0)), 6) as hit, round(coalesce(bpm, tempo), 6) as bpm, round(duration_s - coalesce(start, 0), 6) as segment_s from q",
    "riser_notes": f"{_asked()}, n as (select event_id, len(pitches) as n, pitches, coalesce(hit, duration_s - coalesce(tail, 0)) as h, coalesce(tail, 0) as tail from q), k as (select *, unnest(range(n)) as k from n) select event_id, count(*) * 3 as notes, cast(sum(3 * pitches[k + 1] + 19) as bigint) as pitches, round(max(h * (1 - pow(0.72::double, k)) / (1 - pow(0.72::double, n))), 6) as last_on, round(3 * sum(0.9 * h * pow(0.72::double, k) * 0.28 / (1 - pow(0.72::double, n)) + case when k = n - 1 then tail else 0 end), 6) as sounding from k group by 1",
    "band_levels": """with x as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), y as (select vec_id, i, least(greatest(v, -1), 1)::float::double as v from x),
l as (select vec_id, round(20 * log10(sqrt(avg(v * v)) + 1e-12), 4) as rms_db, round(avg(case when abs(v) >= 0.999 then 1.0 else 0.0 end), 4) as clip_ratio from y group by 1),
f as (select vec_id, k, (sum(v * cos(2 * pi() * k * i / 64)) ** 2 + sum(v * sin(2 * pi() * k * i / 64)) ** 2) as p from y, range(33) t(k) group by 1, 2),
b as (select vec_id, round(10 * log10(coalesce(sum(p) filter (where k between 1 and 5), 0) / 4096 + 1e-30), 4) as mid_db, round(10 * log10(coalesce(sum(p) filter (where k between 6 and 21), 0) / 4096 + 1e-30), 4) as high_db, round(10 * log10(exp(avg(ln(p + 1e-30)) filter (where k between 1 and 13)) / avg(p + 1e-30) filter (where k between 1 and 13)), 4) as flatness_db from f group by 1)
select vec_id, rms_db, clip_ratio, -300.0::double as low_db, mid_db, high_db, flatness_db, -300.0::double as h50 from l join b using (vec_id)""",
    "provenance_texts": """select p_partkey, '{"cadence_version":"2","device":"cpu","sample_rate":48000' || case when p_size % 2 = 0 then ',"seed":' || p_size else '' end || ',"preset":"' || lower(p_type) || '"' || case when p_size > 25 then ',"seconds":' || (p_size / 4.0::double)::varchar else '' end || '}' as text from part""",
}
