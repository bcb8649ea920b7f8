"""Queries of plans, options, catalogues, voices and reports that the other families do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import frames as R
from cadence.operators import intervals as I  # noqa: E741
from cadence.operators import messages as Q
from cadence.operators import metrics as M
from cadence.operators import voice as V
from cadence.plans import options as O  # noqa: E741
from cadence.plans import rules as P
from cadence.plans import documents as W
from cadence.plans import staged as D
from cadence.queries.metrics import EVENTS_SQL, users
from cadence.session import table
from cadence.sources import catalogue as K
from cadence.sources import sinks

r6 = lambda c: F.round(c, 6)


def report_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask next for three goals."""
    asked = [M.next_questions(users(spark, sf_dir), goal).select(F.lit(goal).alias("goal"), "ordinal", "question", "detail") for goal in ("conversion", "all")]
    return asked[0].unionByName(asked[1])


def report_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = users(spark, sf_dir).drop("date").join(table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("date")), "user_id")
    return M.input_summary(rows).withColumn("platforms", F.array_join("platforms", ","))


def report_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.outcome(M.insights(users(spark, sf_dir), "all"))


def speech_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with at least half of their events above 25."""
    f = table(spark, sf_dir, "events").withColumn("active", F.col("value") > 25)
    return V.gate(f, ["user_id"], least=0.5).select("user_id", r6("speech_ratio").alias("speech_ratio"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of each user: level and bands by their values, active where the value is above 12."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("frame", F.row_number().over(order) - 1)
    return e.select("user_id", "frame", (F.col("value") - 60).alias("level_db"), (F.col("value") > 12).alias("active"), (F.col("event_id") % 37 - F.lit(40.0)).alias("sub_db"), (F.col("event_id") % 29 - F.lit(40.0)).alias("mid_db"))


def plosive_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.plosives(_frames(spark, sf_dir), ["user_id"]).select("user_id", F.col("first").cast("long").alias("first"))


def breath_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet runs of more than ten frames, by a low bound of their level."""
    f = _frames(spark, sf_dir).withColumns({"level_db": F.when(F.col("frame") % 40 < 16, F.lit(-45.0) + F.col("frame") % 5).otherwise(-10.0), "high_db": F.col("sub_db"), "low_db": F.col("mid_db")})
    return V.breaths(f, ["user_id"]).select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def stationary_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"), F.count("*").alias("n"))
    return held.select("user_id", R.stationary(F.col("m"), F.col("d") / 3, F.col("n")).alias("still"))


def self_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of 20 hours that overlap none of their user's that stayed before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    e = e.withColumn("end", F.col("start") + 72_000_000_000)
    return I.self_apart(e, ["user_id"], "start", "user_id long, event_id long, start long, end long").select("event_id")


def inspection_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    room = F.when(n % 3 == 0, "low").when(n % 3 == 1, "medium").otherwise("high")
    told = D.recommendations(n % 7, n % 5, n % 4, (n % 6) / 2000.0, (F.col("p_size") - 70).cast("double"), room, F.col("p_size").cast("double"), n % 2 == 0)
    return p.select("p_partkey", F.array_join(told, ",").alias("advice"))


def brief_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = p.select(
        "p_partkey", F.element_at(F.array(F.lit("TikTok"), F.lit("Reels"), F.lit("shorts")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("platform"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("objective"),
        F.element_at(F.array(F.lit("tutorial"), F.lit("dance"), F.lit("story"), F.lit("product")), (F.col("p_size") % 4 + 1).cast("int")).alias("archetype"), F.when(F.col("p_size") % 3 == 0, "buy").alias("cta"),
        F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("duration_s"), F.lit(None).cast("string").alias("speech"), F.lit("no").alias("captions"), F.lit("yes").alias("music"), F.array(F.lit("a.mp4")).cast("string").alias("source_assets"),
    )
    out = D.edit_spec(b.withColumn("objective", F.concat_ws("#", "objective", F.col("p_partkey").cast("string"))))
    return out.select("objective", "platform", "archetype", "duration_s", r6("end_card_s").alias("end_card_s"), F.size("beats").alias("beats"), F.array_join("missing", ",").alias("missing"))


def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs made of parts: what their documents say of platform, archetype, beats and what is lacking."""
    from cadence.plans.documents import edit_document

    p = table(spark, sf_dir, "part")
    word = lambda words, by: F.element_at(F.array(*[F.lit(w) for w in words]), (by % len(words) + 1).cast("int"))
    b = p.select(
        "p_partkey", word(["TikTok", "Reels", "shorts", "vimeo", ""], F.col("p_partkey")).alias("platform"), word(["tutorial", "reaction", "odd"], F.col("p_size")).alias("archetype"), F.when(F.col("p_size") % 4 > 0, "buy").alias("cta"),
        F.when(F.col("p_size") > 3, F.col("p_size") / 2).alias("duration_s"), word(["yes", "no"], F.col("p_size")).alias("speech"), F.when(F.col("p_size") % 5 == 0, "a.mp4").alias("source_assets"),
    )
    d = edit_document(b).select("p_partkey", "document.*")
    return d.select("p_partkey", "brief.platform", "platform_note", "strategy.cut_policy", "audio.priority", F.col("captions.enabled").alias("captions"), F.size("timeline").alias("beats"), F.element_at("timeline", -1)["text"].alias("last_text"), r6(F.element_at("timeline", -1)["start_s"]).alias("last_start"), F.array_join("next_input", ",").alias("next_input"))


def rule_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), (F.col("event_id") / 8).alias("e"))
    return D.rule_plan(words, ["user_id"]).select("user_id", "version", "level", F.element_at("effects", 1)["args"]["hit"].cast("double").alias("hit"), "max_dur", "crf")


def plan_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    other = p.withColumns({"p_size": F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), "p_brand": F.when(F.col("p_partkey") % 7 == 0, "other").otherwise(F.col("p_brand"))})
    return D.compare(p, other, ["p_partkey"], ["p_size", "p_brand"]).select("p_partkey", "column")


def effect_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of zooms and filters made of parts' sizes and prices."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    effect = F.when(F.col("p_partkey") % 2 == 0, "zoom").otherwise("lowpass")
    zoom = F.create_map(F.lit("pct"), (size * 8).cast("string"), F.lit("direction"), F.when(size % 3 == 0, "shrink").otherwise("sideways"))
    low = F.create_map(F.lit("cutoff"), (size * 700).cast("string"), F.lit("order"), F.when(size % 2 == 0, "1").otherwise("3"), F.lit("resonance"), F.lit("1"))
    got = O.violations(p.select("p_partkey", effect.alias("effect"), F.when(effect == "zoom", zoom).otherwise(low).alias("options")))
    return got.select("p_partkey", F.array_join("errors", ";").alias("errors"))


def segments_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = O.segment(F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") - 10.0), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size") * 2.0), F.lit(45.0))
    wrong = O.placement_errors(F.col("p_size") * 1.0, F.col("p_size") + 5.0, F.lit(45.0))
    return p.select("p_partkey", s["start"].alias("start"), s["end"].alias("end"), s["ok"].alias("ok"), F.array_join(wrong, ";").alias("errors"))


def result_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    told = O.quality(F.lit(10.0), F.lit(10.0) + (n % 10) / 10.0, F.lit(30.0), F.lit(30.0) - (n % 3) / 2.0, F.lit(10.6))
    seconds = O.estimate_seconds(F.col("p_size") * 30, F.when(n % 2 == 0, "x4plus").otherwise("animevideov3"), F.when(n % 3 == 0, 720).otherwise(1080))
    return p.select("p_partkey", F.array_join(told, ";").alias("errors"), F.round(seconds, 4).alias("seconds"))


def size_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first wanted size that a part has, of those that are not empty."""
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    entry = lambda url, size: F.struct(url.alias("url"), F.lit(1).alias("width"), F.lit(1).alias("height"), size.cast("long").alias("size"), F.lit("").alias("thumbnail"))
    sizes = F.create_map(F.lit("large"), entry(F.when(n % 3 == 0, "l").otherwise(""), n % 2), F.lit("medium"), entry(F.when(n % 5 == 0, "m").otherwise(""), F.lit(0)), F.lit("small"), entry(F.lit("s"), F.lit(9)))
    hits = K.trimmed(p.select("p_partkey", sizes.alias("sizes")))
    return hits.select("p_partkey", F.size("sizes").alias("n"), K.choose(F.col("sizes"), ["large", "medium", "small"])["url"].alias("url"))


def cache_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cached answers to their customers' address: the newest of the last day of the table."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("url"), F.col("o_orderkey").cast("string").alias("payload"), (F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0,0,0,0,0,0,o_orderkey % 86400)")).alias("cached_at"))
    now = o.agg(F.max("cached_at").alias("now")).first()["now"]
    return K.fresh(o, F.lit(now)).select("key", "payload")


def header_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    held = F.create_map(F.lit("to"), F.col("o_orderstatus"), F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("about"), F.col("o_orderpriority"))
    return o.select("o_orderkey", Q.render(Q.upsert(held, "id", F.concat(F.lit("m"), F.col("o_orderkey").cast("string"))), ["id", "from"]).alias("text"))


def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = sinks.message_name(F.substring("o_orderpriority", 1, 1), F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey"), F.lit("clerk"), F.col("o_orderstatus"))
    return o.select("o_orderkey", name.alias("name"))


def draft_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the lines of drafts made of orders."""
    n = F.col("o_orderkey")
    text = F.concat_ws("\n", F.lit("to: a"), F.when(n % 2 == 0, "id: 1").otherwise("task: x"), F.when(n % 3 == 0, "task: y").otherwise("note"), F.when(n % 5 == 0, "colour: red"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(Q.line_errors(text, ["id"], ["to", "task"])).alias("e"))
    return found.select("o_orderkey", F.col("e.line").cast("int").alias("line"), F.col("e.error").alias("error"))


def prefix_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by the beginning of their names: one, none or several."""
    nations = table(spark, sf_dir, "nation").select("n_name")
    asked = nations.select(F.substring("n_name", 1, 2).alias("prefix")).distinct().unionByName(spark.createDataFrame([("QQ",)], "prefix string"))
    return P.resolve_prefix(asked, nations, "prefix", "n_name").select("prefix", "matches", "n_name")


def frame_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("cell"))
    return O.waypoints(cells, None, ["region"], 2.0, 0.5).select("region", "cell", "at")


def rounded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence by count, and shares clipped to their range."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return g.select("user_id", r6(V.count_confidence(F.col("n") % 20)).alias("confidence"), r6(R.clip(F.col("v") * 2 - 30, 0.0, 50.0)).alias("share"), S.is_percent(F.lit("5 %")).alias("percent"))


QUERIES = {f.__name__: f for f in (report_questions, report_input, report_outcome, speech_gate, plosive_onsets, breath_runs, stationary_noise, self_apart, inspection_advice, brief_specs, spec_documents, rule_plans, plan_differences, effect_options, segments_kept, result_quality, size_choice, cache_answers, header_render, message_files, draft_errors, prefix_objects, frame_waypoints, rounded_rates)}

_FRAMES = "fr as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as frame, value, event_id, value > 12 as active, event_id % 37 - 40.0::double as sub_db, event_id % 29 - 40.0::double as mid_db from events)"
ORACLES = {
    "report_outcome": EVENTS_SQL + "select 'repeat what the best have in common and change one thing' as priority_action, 'a higher median score' as expected_outcome, 'the goal''s metrics of the next variants' as measure_next, case when count(goal_score) >= 20 then 'high' when count(goal_score) >= 8 then 'medium' else 'low' end as confidence from s having count(goal_score) >= 3",
    "report_questions": EVENTS_SQL + ", w(goal, place, field) as (values " + ", ".join(f"('{g}', {k}, '{f}')" for g in ("conversion", "all") for k, f in enumerate(M.NEEDS[g])) + "), h as (select goal, place, field, case field when 'views' then (select count(views) from s) when 'clicks' then (select count(clicks) from s) when 'conversions' then (select count(conversions) from s) when 'follows' then (select count(follows) from s) when 'likes' then (select count(likes) from s) when 'revenue' then (select count(revenue) from s) when 'platform' then (select count(platform) from s) when 'topic' then (select count(topic) from s) else 0 end as present, (select count(*) from s) as total from w), f as (select * from h where present < greatest(2, ceil(total * 0.5))), l as (select goal, list(field order by place) as fields from f group by 1) select goal, 1 as ordinal, 'fields' as question, array_to_string(fields[1:5], ',') as detail from l union all select goal, 2, 'changes', 'audience,date,audio,hook,spend' from l",
    "report_input": EVENTS_SQL + ", t as (select user_id, strftime(min(ts), '%Y-%m-%d') as d from events group by 1) select (select count(*) from s) as rows, (select string_agg(p, ',' order by p) from (select distinct coalesce(platform, 'unknown') as p from s)) as platforms, (select min(d) from t) as date_min, (select max(d) from t) as date_max",
    "speech_gate": "select user_id, round(avg((value > 25)::int), 6) as speech_ratio from events group by 1 having avg((value > 25)::int) >= 0.5",
    "plosive_onsets": f"with {_FRAMES}, g as (select *, frame - row_number() over (partition by user_id, active order by frame) as g from fr), r as (select user_id, min(frame) as first from g where active group by user_id, g) select r.user_id, r.first from r join fr on fr.user_id = r.user_id and fr.frame >= r.first and fr.frame < r.first + 5 group by 1, 2 having 10 * log10(sum(pow(10, sub_db / 10))) - 10 * log10(sum(pow(10, mid_db / 10))) > 6",
    "breath_runs": f"with {_FRAMES}, q as (select *, frame % 40 < 16 as quiet, -45.0::double + frame % 5 as lv from fr), n as (select user_id, max(frame) as top from fr group by 1), g as (select *, frame - row_number() over (partition by user_id, quiet order by frame) as g from q), r as (select user_id, g, min(frame) as first, max(frame) as last, sum(pow(10, sub_db / 10)) as hi, sum(pow(10, mid_db / 10)) as lo from g where quiet group by 1, 2), p as (select r.*, (select max(lv) from g where g.user_id = r.user_id and g.quiet and g.frame >= r.first and g.frame < r.last) as peak from r) select p.user_id, first, last from p join n using (user_id) where last - first between 10 and 80 and peak between -55 and -30 and (first > 0 or last < top) and hi > lo",
    "stationary_noise": "select user_id, count(*) > 4 and stddev_pop(value) / 3 / (abs(avg(value)) + 1e-9) < 0.35 as still from events group by 1",
    "self_apart": "with recursive x as (select user_id, event_id, epoch_us(ts) as us from events), k as (select user_id, min(us) as us from x group by 1 union all select user_id, us from (select x.user_id, min(x.us) as us from k join x on x.user_id = k.user_id and x.us >= k.us + 72000000000 group by x.user_id)) select event_id from k join x using (user_id, us)",
    "inspection_advice": "with x as (select p_partkey as n, p_size as z from part) select n as p_partkey, concat_ws(',', case when n % 7 >= 5 then 'declick' end, case when n % 5 >= 3 then 'tame_breaths' end, case when n % 4 >= 2 then 'deplosive' end, case when (n % 6) / 2000.0::double > 0.001 then 'declip' end, case when z - 70 > -45 then 'dehum' end, case when n % 3 > 0 then 'dereverb' end, case when z < 15 then 'enhance' else 'master_only' end, case when n % 2 = 0 then 'stationary_noise' end) as advice from x",
    "brief_specs": "with x as (select *, case when p_size > 5 then p_size::double else 20.0::double end as d from part) select concat_ws('#', case when p_size % 2 = 0 then p_type end, p_partkey::varchar) as objective, ['tiktok', 'instagram_reels', 'youtube_shorts'][p_partkey % 3 + 1] as platform, ['tutorial', 'talking_head', 'story', 'product'][p_size % 4 + 1] as archetype, d as duration_s, round(greatest(0, case when d <= 10 then d - 0.8::double when d <= 30 then d - 1.5::double else d - 2.0::double end), 6) as end_card_s, case when d <= 8 then 4 else 5 end as beats, case when p_size % 3 = 0 then '' else 'cta' end as missing from x",
    "spec_documents": f"""with x as (select *, ['tiktok', 'instagram_reels', 'youtube_shorts', 'vimeo', 'tiktok'][p_partkey % 5 + 1] as pf, case when p_size > 3 then p_size / 2.0::double else 20.0::double end as d, case when p_size % 4 > 0 then 'buy' else 'none' end as cta from part),
y as (select *, case when d <= 10 then greatest(0, d - 0.8) when d <= 30 then greatest(0, d - 1.5) else greatest(0, d - 2) end as card, least(2.5, greatest(least(0.7, d) + 0.1, d * 0.18)) as promise from x)
select p_partkey, pf as platform, case pf when 'tiktok' then '{W.PLATFORMS["tiktok"]}' when 'instagram_reels' then '{W.PLATFORMS["instagram_reels"]}' when 'youtube_shorts' then '{W.PLATFORMS["youtube_shorts"]}' else '{W.ELSEWHERE}' end as platform_note,
case p_size % 3 when 0 then '{W.ARCHETYPES["tutorial"][0]}' when 1 then '{W.ARCHETYPES["reaction"][0]}' else '{W.ARCHETYPES["talking_head"][0]}' end as cut_policy, case when p_size % 2 = 0 then 'voice > music > effects' else 'music > effects' end as priority, p_size % 2 = 0 as captions,
case when d <= 8 then 4 else 5 end as beats, replace(case when d <= 8 then '{W.BEATS["payoff"][2]}' else '{W.BEATS["payoff_cta"][2]}' end, '{{cta}}', cta) as last_text,
round(round(case when d <= 8 then greatest(promise, d - 1) else greatest(least(8, greatest(promise + 0.5, d * 0.38)), card) end, 3), 6) as last_start, case when p_size % 5 = 0 then 'transcript_or_timecodes' else 'source_assets,transcript_or_timecodes' end as next_input from y""",
    "rule_plans": "select user_id, 1 as version, 'medium' as level, round(max(event_id) / 8.0::double, 2) as hit, 60.0::double as max_dur, 18 as crf from events group by 1",
    "plan_differences": "select p_partkey, 'p_size' as \"column\" from part where p_partkey % 5 = 0 union all select p_partkey, 'p_brand' from part where p_partkey % 7 = 0 and p_brand <> 'other'",
    "effect_options": "with x as (select *, p_partkey % 2 = 0 as z from part) select p_partkey, concat_ws(';', case when z and (p_size * 8 > 200 or p_size * 8 <= 0) then 'zoom.pct' end, case when z and p_size % 3 > 0 then 'zoom.direction' end, case when not z and (p_size * 700 > 20000 or p_size * 700 < 20) then 'lowpass.cutoff' end, case when not z and p_size % 2 = 1 then 'lowpass.order' end, case when z and p_size % 3 = 0 and p_size * 8 >= 100 then 'shrink to nothing' end, case when not z and p_size % 2 = 0 then 'resonance of a first-order filter' end) as errors from x",
    "segments_kept": "with x as (select p_partkey, p_size, greatest(coalesce(case when p_partkey % 3 > 0 then p_size - 10.0::double end, 0), 0) as a, least(coalesce(case when p_partkey % 4 > 0 then p_size * 2.0::double end, 45), 45) as b from part) select p_partkey, a::double as start, b::double as \"end\", a < b as ok, concat_ws(';', case when p_size >= 45 then 'starts after the clip' end, case when p_size + 5 > 45 then 'ends after the clip' end) as errors from x",
    "result_quality": "with x as (select p_partkey, p_partkey as n, p_size, 10.0::double + (p_partkey % 10) / 10.0::double as o from part) select p_partkey, concat_ws(';', case when abs(10.0::double - o) > 0.3::double then 'length drifts' end, case when (n % 3) / 2.0 > 0.5 then 'frame rate drifts' end, case when o > 10.6::double then 'too long' end) as errors, round(p_size * 30 / case when n % 2 = 0 then case when n % 3 = 0 then 0.12::double else 0.04::double end else case when n % 3 = 0 then 0.85::double else 0.39::double end end, 4) as seconds from x",
    "size_choice": "with x as (select p_partkey as n, p_partkey % 3 = 0 or p_partkey % 2 > 0 as l, p_partkey % 5 = 0 as m from part) select n as p_partkey, 1 + l::int + m::int as n, case when l then case when n % 3 = 0 then 'l' else '' end when m then 'm' else 's' end as url from x",
    "cache_answers": "with x as (select o_custkey::varchar as url, o_orderkey::varchar as payload, o_orderdate + to_seconds(o_orderkey % 86400) as stored from orders), n as (select max(stored) as now from x) select sha1(url) as key, max_by(payload, stored) as payload from x, n where stored >= now - interval 86400 second group by 1",
    "header_render": "select o_orderkey, 'id: m' || o_orderkey || chr(10) || 'about: ' || o_orderpriority || chr(10) || 'to: ' || o_orderstatus as text from orders",
    "message_files": "select o_orderkey, substr(o_orderpriority, 1, 1) || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '_' || printf('%06d', o_orderkey) || '_from_clerk_to_' || o_orderstatus as name from orders",
    "draft_errors": "with o as (select o_orderkey as n from orders) select n as o_orderkey, 2 as line, 'reserved' as error from o where n % 2 = 0 union all select n, 3, case when n % 3 > 0 then 'not a header' else 'duplicate' end from o where n % 3 > 0 or n % 2 = 1 union all select n, 4, 'unknown' from o where n % 5 = 0",
    "prefix_objects": "with a as (select distinct substr(n_name, 1, 2) as prefix from nation union all select 'QQ'), m as (select prefix, count(n_name) as matches, min(n_name) as name from a left join nation on starts_with(n_name, prefix) group by 1) select prefix, matches, case when matches = 1 then name end as n_name from m",
    "frame_waypoints": "select n_regionkey as region, n_nationkey as cell, (row_number() over (partition by n_regionkey order by n_nationkey) - 1) * 2.5::double as at from nation",
    "rounded_rates": "select user_id, round(least(0.3::double + 0.05::double * (count(*) % 20), 0.9::double), 6) as confidence, round(least(greatest(avg(value) * 2 - 30, 0), 50), 6) as share, true as percent from events group by 1",
}
