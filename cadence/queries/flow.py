"""Queries of word-timed text, specs, scenarios, queues, votes, vectors and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import cues as C
from cadence.operators import messages as Q
from cadence.operators import scenarios as N
from cadence.operators import votes as V
from cadence.plans import rules as P
from cadence.plans import staged as D
from cadence.session import table
from cadence.sources import catalogue as K
from cadence.streaming import events as E

r6 = lambda c: F.round(c, 6)
KEYS = ["conv_id", "turn"]
HOOKS = [("now see", "The", 1.0), ("one two three four five", "the", 1.0), ("never", "xyzzy", 0.0)]


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns, timed by their characters in whole milliseconds: 60 a character and 120 a word, pauses of 40, or 640 after a full stop."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\\s+")).alias("pos", "w")).filter("w <> ''")
    order = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    dur = F.length("w") * 60 + 120
    step = dur + F.when(F.col("w").endswith("."), 640).otherwise(40)
    c = c.withColumns({"__d": dur, "__t": F.sum(step).over(order) - step})
    return c.select("conv_id", "turn", "pos", "w", (F.col("__t") / 1000).alias("s"), ((F.col("__t") + F.col("__d")) / 1000).alias("e"))


def cue_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = C.breaks(words(spark, sf_dir), KEYS)
    return b.groupBy("conv_id").agg(F.count_if("good").alias("good"), F.count_if("bad").alias("bad"), F.count("*").alias("words"))


def cue_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.islands(words(spark, sf_dir), KEYS).groupBy(*KEYS, "island").agg(F.count("*").alias("words"), F.sum(F.length("w")).alias("chars"), F.round(F.min("s"), 3).alias("s"), F.round(F.max("e"), 3).alias("e"))


def cue_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pack(words(spark, sf_dir), KEYS).select("conv_id", "turn", "pos", "words", "chars", "good", "text")


def cue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pairs(C.pack(words(spark, sf_dir), KEYS), KEYS).groupBy("conv_id", "turn", "event").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.islands(words(spark, sf_dir), KEYS).groupBy(*KEYS, "island").agg(F.min("pos").alias("pos"), F.sum(F.length("w")).alias("chars"), F.round(F.min("s"), 3).alias("s"), F.round(F.max("e"), 3).alias("e"))


def cue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.audit(_islands(spark, sf_dir), 11.5, 12.5, 0.83).select("conv_id", "turn", "pos", "severity", "rule")


def event_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.times(_islands(spark, sf_dir), KEYS).select("conv_id", "turn", "pos", r6("end").alias("end"))


def subtitle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.times(_islands(spark, sf_dir), KEYS)
    return t.select("conv_id", "turn", "pos", C.dialogue(F.floor(F.col("s")), F.floor(F.col("end")) + 1, F.concat(F.lit("cue\n"), F.col("pos").cast("string"))).alias("line"))


def first_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place in each document of the first word of each benchmark item."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\\s+")).alias("pos", "w"))
    hooks = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", "\\s+")[0].alias("anchor"), F.lit(0.9).alias("dur"))
    met = C.anchors(d.withColumn("e", F.col("pos").cast("double")), hooks, ["doc_id"])
    return met.select("doc_id", "item_id", "pos")


def locale_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal signs and clocks of prices and times in both variants."""
    o = table(spark, sf_dir, "orders")
    minutes = F.col("o_orderkey") % 1440
    clock = F.format_string("%d:%02d", F.floor(minutes / 60), minutes % 60)
    comma = F.concat(F.lit("a las "), clock, F.lit(" vale "), F.floor("o_totalprice").cast("long").cast("string"), F.lit(",5 euros"))
    point = F.replace(comma, F.lit(",5"), F.lit(".5"))
    return o.select("o_orderkey", S.locale_text(comma, "es-LATAM").alias("latam"), S.locale_text(point, "es-ES").alias("spain"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature for each order, a scenario for each of its lines: a returned line has two examples, an accepted one has one, others have none."""
    step = lambda keyword, text: F.struct(F.lit(keyword).alias("keyword"), F.lit(text).alias("text"))
    example = lambda part, flag: F.create_map(F.lit("part"), part.cast("string"), F.lit("flag"), flag)
    own, other = example(F.col("l_partkey"), F.col("l_returnflag")), example(F.lit(0), F.lit("X"))
    examples = F.when(F.col("l_returnflag") == "R", F.array(own, other)).when(F.col("l_returnflag") == "A", F.array(own)).otherwise(F.array().cast("array<map<string,string>>"))
    moving = F.array(step("When", "part <part> moves"), step("Then", "flag <flag> shows"))
    steps = F.when(F.col("l_returnflag") == "N", F.array(step("Then", "nothing happens"))).otherwise(moving)
    scenario = F.struct(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("name"), steps.alias("steps"), examples.alias("examples"))
    held = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("order"), scenario.alias("s"))
    first = held.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("order")))
    whole = first.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", F.to_json("s").alias("s")))).alias("x"))
    kind = N.FEATURE.split("scenarios array<")[1][:-1]
    return whole.select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("name"), F.array(step("Given", "a shop")).alias("background"), F.transform("x", lambda x: F.from_json(x["s"], kind)).alias("scenarios"))


def scenario_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.expand(_features(spark, sf_dir)).select("feature", "scenario_index", "example_index", "name", F.size("steps").alias("steps"))


def placeholder_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template filled for every nation."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    held = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("m", F.create_map(F.lit("nation"), "n_name", F.lit("region"), "r_name"))
    return held.select("n_nationkey", S.fill(F.lit("nation <nation> of <region>, again <nation>"), F.col("m")).alias("text"))


HANDLERS = [("shop", "a shop"), ("part", "part [0-9]+ moves"), ("flag", "flag [AR] shows"), ("any_flag", "flag .*")]


def first_match_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.route(N.steps(N.expand(_features(spark, sf_dir))), HANDLERS, ["feature", "scenario_index", "example_index", "step"]).select("feature", "scenario_index", "example_index", "step", "text", "handler")


def spec_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects with arguments from events: some are no number, choice, point or argument of theirs."""
    k, pct = F.col("event_id") % 7, F.when(F.col("value") > 50, "big").otherwise(F.floor("value").cast("string"))
    given = lambda *pairs: F.create_map(*[v if not isinstance(v, str) else F.lit(v) for v in pairs])
    args = (
        F.when(k == 0, given("pct", pct, "easing", "smooth")).when(k == 1, given("pct", "5", "easing", F.col("event_type"))).when(k == 2, given("hit", "3.5", "colour", "red"))
        .when(k == 3, given("center", "0.5,0.5")).when(k == 4, given("center", F.col("event_type"))).when(k == 5, given("x", "1")).otherwise(F.create_map().cast("map<string,string>"))
    )
    cmd = F.when(k < 2, "video zoom").when(k == 2, "audio riser").when(k < 5, "video magnify").when(k == 5, "video explode").otherwise("audio melody")
    return P.argument_errors(table(spark, sf_dir, "events").select("event_id", cmd.alias("cmd"), args.alias("args"))).select("event_id", "arg", "error")


def message_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of orders as messages: priorities of one to three digits, and a fault by the order's number."""
    k = F.col("o_orderkey") % 7
    own = [
        {"type": "note", "to": "coder", "message": "hello"}, {"type": "note", "to": "coder,coder", "message": "x" * 81}, {"type": "git_handoff", "to": "coder,tester", "task": "t", "commit": "0123456789"},
        {"type": "git_handoff", "to": "nobody", "commit": "xyz"}, {"to": ""}, {"type": "memo", "to": "big_boss"}, {"type": "note", "to": "tester", "message": "m", "commit": "0123456789"},
    ]
    headers = F.lit(None).cast("map<string,string>")
    for i, h in enumerate(own):
        headers = F.when(k == i, F.create_map(*[F.lit(x) for pair in h.items() for x in pair], F.lit("priority"), (F.col("o_orderkey") % 120).cast("string"))).otherwise(headers)
    o = table(spark, sf_dir, "orders").withColumn("headers", headers)
    return o.select("o_orderkey", F.array_join(P.message_errors(F.col("headers"), ["coder", "tester"]), "; ").alias("errors"))


def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return P.unknown_entries(e, F.concat(F.map_keys(F.from_json("props", "map<string,string>")), F.array("event_type")), ["k", "view"])


def mastering_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 16
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.when(k % 2 == 1, F.lit(50)).alias("dehum"), (F.floor(k / 2) % 2 == 1).alias("no_eq"), (F.floor(k / 4) % 2 == 1).alias("no_comp"), (F.floor(k / 8) % 2 == 1).alias("no_limit"), F.lit(False).alias("no_loudnorm")).alias("o"))
    return e.select("event_id", F.array_join(D.chain(F.col("o")), ">").alias("stages"))


def beat_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") % 80 + 1) / 2.0).alias("d"))
    return d.select("id", F.inline(D.timeline(F.col("d")))).select("id", r6("start_s").alias("start_s"), r6("end_s").alias("end_s"), "beat")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    to = F.when(F.col("o_orderkey") % 97 == 0, "O,X").when(F.col("o_orderkey") % 3 == 0, "O,P").otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("o_orderdate").alias("created"), to.alias("to"), F.col("o_orderstatus").alias("role"))


ROLES = [("O",), ("P",), ("F",)]


def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = Q.fan_out(_orders(spark, sf_dir), spark.createDataFrame(ROLES, "role string"))
    return good.select("id", "recipient")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.fan_out(_orders(spark, sf_dir), spark.createDataFrame(ROLES, "role string"))[1].select("id", "to")


def queue_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.next_task(_orders(spark, sf_dir), "role", ["priority", "created", "id"]).select("role", "id", "priority")


def queue_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.next_batch(_orders(spark, sf_dir), "role", "priority").select("role", "id")


def queue_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to last shipment, by priority."""
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    completed, _ = Q.complete(table(spark, sf_dir, "orders"), done, "o_orderkey", "o_orderdate", "l_shipdate", ["o_orderpriority"])
    return Q.latency(completed, ["o_orderpriority"])


def queue_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.sequence(_orders(spark, sf_dir).select("id", "created"), ["created", "id"]).select("id", F.format_string("%06d", F.col("sequence")).alias("number"))


def queue_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as a queue: finished ones were worked on, shipped ones are done, and whoever is free takes the next open one."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    taken = F.when(F.col("o_orderstatus") == "F", at)
    queue = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("role"), F.substring("o_orderpriority", 1, 1).alias("priority"), at.alias("created"), taken.alias("dequeued_at"), F.lit(None).cast(o.schema["o_orderdate"].dataType).alias("completed_at"))
    done = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ended"))
    out = Q.advance(queue, done, F.lit("2030-01-01 00:00:00").cast(o.schema["o_orderdate"].dataType), ["priority", "created"])
    return out.select("id", "role", F.date_format("dequeued_at", "yyyy-MM-dd").alias("dequeued"), F.date_format("completed_at", "yyyy-MM-dd").alias("completed"))


def batch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers as one numbered batch of messages."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit("to: "), "s_name").alias("text"))
    return Q.batch_text(s, "s_nationkey", ["s_suppkey"])


def mailbox_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' messages published as files, twice, and read back: each stands once."""
    from cadence.sources import mailbox, sinks

    spark.dataSource.register(mailbox.Mailbox)
    folder = E.scratch(spark, "mailbox")
    s = table(spark, sf_dir, "supplier")
    name = sinks.message_name(F.lit("1"), F.lit("2024-05-06 07:08:09").cast("timestamp"), F.col("s_suppkey") + 999_990, F.lit("clerk"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    rows = s.select(name.alias("name"), F.concat(F.lit("id: "), F.col("s_suppkey").cast("string"), F.lit("\nto: n"), F.col("s_nationkey").cast("string"), F.lit("\n\n"), "s_name").alias("text"))
    for _ in range(2):
        rows.write.format("mailbox").option("path", folder).mode("append").save()
    back = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("name"), Q.parse(F.col("value")).alias("m"))
    return back.select("name", F.try_element_at("m.headers", F.lit("id")).alias("id"), F.try_element_at("m.headers", F.lit("to")).alias("recipient"), F.col("m.body").alias("body"))


def sorted_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median price of each part's lines, by places in one sort."""
    from cadence.operators import ranges

    m = ranges.medians(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice")
    return m.select("l_partkey", r6("median").alias("median"))


def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rendered as messages and read again."""
    o = _orders(spark, sf_dir)
    text = F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\npriority: 0"), "priority", F.lit("\nto: "), "to", F.lit("\n\nbody "), F.col("id").cast("string"))
    m = o.select("id", Q.parse(text).alias("m"))
    return m.select("id", F.try_element_at("m.headers", F.lit("priority")).alias("priority"), F.size("m.headers").alias("headers"), F.col("m.body").alias("body"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the next one by id."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("v"))
    return a.join(b, "a").select("a", F.round(V.cosine(F.col("u"), F.col("v")), 5).alias("cosine"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as votes: sides change by number, scores are the value's, some are left out or no number."""
    n = F.col("event_id")
    pair = F.when(n % 3 == 0, "CD").otherwise("AB")
    file = lambda k: F.concat(F.lit("x_"), F.substring(pair, k, 1), F.lit(".wav"))
    score = lambda by: F.when(n % 7 == 0, "").when(n % 11 == 0, "n/a").otherwise((F.floor("value") % by + 1).cast("string"))
    chosen = F.when(F.col("event_type") == "view", "A").when(F.col("event_type") == "click", "b").when(F.col("event_type") == "error", "B").otherwise("tie")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("listener"), (n % 50).cast("string").alias("clip_id"), pair.alias("pair"), F.when(n % 2 == 0, file(1)).otherwise(file(2)).alias("side_a_file"), F.when(n % 2 == 0, file(2)).otherwise(file(1)).alias("side_b_file"), chosen.alias("preferred"), score(5).alias("mos_a"), score(4).alias("mos_b"))


def vote_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.preference(_votes(spark, sf_dir)).select("pair", "won", "n", r6("share").alias("share"))


def vote_mos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.opinion(_votes(spark, sf_dir)).select("condition", "n", r6("mos").alias("mos"))


def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.manifest(table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string"))), "name", "p_size")


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of 25 parts by name, kind and size bounds, dearest first."""
    asked = {"text": "ring", "text_col": "p_name", "equal": {"p_type": ["ECONOMY", "SMALL"]}, "ranges": {"p_size": (5, 40)}}
    return K.search(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), "p_partkey"], page=2, per_page=25, **asked).select("p_partkey", "p_name", "p_retailprice")


def hook_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks that a conversation's turns have no anchor for, or that are too long."""
    hooks = spark.createDataFrame(HOOKS, "text string, anchor string, dur double")
    return C.hook_errors(words(spark, sf_dir), hooks, KEYS).groupBy("text", "error").agg(F.count("*").alias("n"))


def in_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's open orders say of being worked on."""
    held = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("role"), F.col("o_orderkey").alias("id"))
    return Q.in_process(held, "role").select("role", "n", "id", "state")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users (gap six hours) from a stream of event files in time order, closed by one row far ahead."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    path = E.scratch(spark, "events")
    E.replay(e, "at", 4, path)
    spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("at")).write.mode("append").parquet(path)
    spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("2100-01-02 00:00:00").cast("timestamp").alias("at")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = E.scratch(spark, "sessions")
    E.run_once(E.sessions(stream, "user_id", "at", "6 hours", "1 hour"), out, E.scratch(spark, "state"))
    return spark.read.parquet(out).filter("user_id >= 0").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that come twice over a stream, delivered once to each recipient."""
    o = _orders(spark, sf_dir).select("id", "to")
    path = E.scratch(spark, "messages")
    E.replay(o, "id", 3, path)
    o.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = E.scratch(spark, "delivered")
    E.deliver(stream, spark.createDataFrame(ROLES, "role string"), out, E.scratch(spark, "state"))
    return spark.read.parquet(out).select("id", "recipient")


def attack_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.smooth_levels(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.5, 0.1).select("event_id", "smooth")


QUERIES = {f.__name__: f for f in (cue_breaks, cue_islands, cue_pack, cue_pairs, cue_audit, event_timing, subtitle_lines, first_anchor, locale_rewrite, scenario_expand, placeholder_fill, first_match_route, spec_violations, message_violations, unknown_keys, mastering_chain, beat_timeline, fanout, dead_letters, queue_next, queue_batch, queue_latency, queue_sequence, queue_advance, batch_texts, mailbox_files, sorted_medians, header_parse, cosine_pairs, vote_preference, vote_mos, manifest_hash, catalog_search, hook_gaps, in_process, stream_sessions, stream_queue, attack_release)}


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_WORDS = """sw as (select conv_id, turn, unnest(string_split_regex(text, '\\s+')) as w, generate_subscripts(string_split_regex(text, '\\s+'), 1) - 1 as pos from conversations),
wd as (select *, length(w) * 60 + 120 as d, length(w) * 60 + 120 + case when w like '%.' then 640 else 40 end as step from sw where w <> ''),
wt as (select *, sum(step) over (partition by conv_id, turn order by pos rows unbounded preceding) - step as t from wd),
word as (select conv_id, turn, pos, w, t / 1000.0::double as s, (t + d) / 1000.0::double as e from wt)"""
_ISLE = _WORDS + """, iw as (select *, sum(case when s - pe > 0.5 then 1 else 0 end) over (partition by conv_id, turn order by pos rows unbounded preceding) as island from (select *, lag(e) over (partition by conv_id, turn order by pos) as pe from word)),
isle as (select conv_id, turn, island, min(pos) as pos, count(*) as words, cast(sum(length(w)) as bigint) as chars, round(min(s), 3) as s, round(max(e), 3) as e from iw group by 1, 2, 3)"""
_TIMES = _ISLE + """, tm as (select *, least(greatest(e + 0.15, s + 0.83), lead(s) over (partition by conv_id, turn order by s, pos) - 2 / 30.0::double) as x from isle), te as (select *, case when x <= s then s + 0.04 else x end as stop from tm)"""
_TOKEN = "regexp_replace(lower(trim({w})), '[.,!?;:]+$', '')"

_BREAKS = f"""{_WORDS}, bn as (select *, lead(w) over (partition by conv_id, turn order by pos) as nx, lag(e) over (partition by conv_id, turn order by pos) as pe from word),
bt as (select *, {_TOKEN.format(w='w')} as a, {_TOKEN.format(w='nx')} as b from bn),
bf as (select conv_id, turn, pos, w, s, e, sum(case when s - pe > 0.5 then 1 else 0 end) over (partition by conv_id, turn order by pos rows unbounded preceding) as island,
  coalesce(regexp_matches(w, '[.,!?;:]$') or b in ({_list([*C.CONJUNCTIONS, *C.PREPOSITIONS])}), false) as good,
  coalesce(a in ({_list([*C.ARTICLES, *C.PREPOSITIONS, *C.AUXILIARIES])}) or (length(trim(w)) > 1 and regexp_matches(trim(w), '^\\p{{Lu}}') and length(trim(nx)) > 1 and regexp_matches(trim(nx), '^\\p{{Lu}}') and a not in ({_list(C.CONJUNCTIONS)})), false) as bad from bt)"""
#: Lines, one after another: from a line's first word, the first word that makes it too long; where the line should not end there, the words after its last good end go along.
_CUES = _BREAKS + """, wi as (select *, row_number() over i as i, sum(length(w)) over (i rows unbounded preceding) as upto from bf window i as (partition by conv_id, turn, island order by pos)),
wl as (select *, lag(e) over i as pe, lag(bad) over i as pbad, max(case when good then i end) over (i rows between unbounded preceding and 2 preceding) as lastgood from wi window i as (partition by conv_id, turn, island order by pos)),
ln as (select conv_id, turn, island, i as first, 2 as look from wl where i = 1
  union all
  select conv_id, turn, island, start, i + 1 from (
    select x.conv_id, x.turn, x.island, x.i, case when x.pbad and x.lastgood >= f.i then x.lastgood + 1 else x.i end as start, row_number() over (partition by x.conv_id, x.turn, x.island order by x.i) as k
    from ln join wl f on f.conv_id = ln.conv_id and f.turn = ln.turn and f.island = ln.island and f.i = ln.first
    join wl x on x.conv_id = ln.conv_id and x.turn = ln.turn and x.island = ln.island and x.i >= ln.look and x.i > ln.first
    where x.upto - f.upto + length(f.w) > 34 or (x.upto - f.upto + length(f.w)) / 17.0::double > x.pe - f.s + 0.5) where k = 1),
wn as (select wl.*, (select max(first) from ln where ln.conv_id = wl.conv_id and ln.turn = wl.turn and ln.island = wl.island and ln.first <= wl.i) as line from wl),
cue as (select conv_id, turn, min(pos) as pos, count(*) as words, cast(sum(length(w)) as bigint) as chars, max_by(good, pos) as good, string_agg(w, ' ' order by pos) as text, min(s) as s, max(e) as e from wn group by conv_id, turn, island, line)"""
_PAIRS = _CUES + """, cn as (select *, row_number() over t as n, lead(chars) over t as chars2, lead(s) over t as s2, lead(e) over t as e2 from cue window t as (partition by conv_id, turn order by pos)),
cc as (select *, coalesce(good and s2 - e <= 0.5 and chars <= 25 and chars2 <= 25 and e2 - s > 0 and (chars + chars2) / 17.0::double <= e2 - s + 0.5, false) as can from cn),
ev as (select conv_id, turn, n, pos as event, can from cc where n = 1
  union all select c.conv_id, c.turn, c.n, c.pos, c.can from ev join cc c on c.conv_id = ev.conv_id and c.turn = ev.turn and c.n = ev.n + case when ev.can then 2 else 1 end)"""
_MSG = "ord as (select o_orderkey as id, substr(o_orderpriority, 1, 1) as priority, o_orderdate as created, case when o_orderkey % 97 = 0 then 'O,X' when o_orderkey % 3 = 0 then 'O,P' else o_orderstatus end as to_, o_orderstatus as role from orders)"
_CLOCK = "case when h = 0 then '12' when h <= 12 then cast(h as varchar) else cast(h - 12 as varchar) end || ':' || lpad(cast(m as varchar), 2, '0') || case when h < 12 then ' a. m.' else ' p. m.' end"

_SCENARIOS = """line as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as scenario_index from lineitem),
ex as (select 'order ' || l_orderkey as feature, cast(scenario_index as int) as scenario_index, e as example_index, 'line ' || l_linenumber || '/example_' || e as name, l_returnflag as flag, case when e = 2 then '0' else l_partkey::varchar end as part, case when e = 2 then 'X' else l_returnflag end as shown
  from line join (values (1), (2)) x(e) on e = 1 or l_returnflag = 'R')"""
_VOTES = """vt as (select case when event_id % 3 = 0 then 'CD' else 'AB' end as pair, event_id % 2 = 0 as straight, case when event_type = 'view' then 'a' when event_type in ('click', 'error') then 'b' else 'tie' end as side,
case when event_id % 7 > 0 and event_id % 11 > 0 then floor(value) % 5 + 1 end as ma, case when event_id % 7 > 0 and event_id % 11 > 0 then floor(value) % 4 + 1 end as mb from events),
vs as (select *, case when straight then pair[1] else pair[2] end as a, case when straight then pair[2] else pair[1] end as b from vt)"""

ORACLES = {
    "cue_breaks": f"with {_WORDS}, n as (select *, lead(w) over (partition by conv_id, turn order by pos) as nx from word), t as (select *, {_TOKEN.format(w='w')} as a, {_TOKEN.format(w='nx')} as b from n), f as (select conv_id, coalesce(regexp_matches(w, '[.,!?;:]$') or b in ({_list([*C.CONJUNCTIONS, *C.PREPOSITIONS])}), false) as good, coalesce(a in ({_list([*C.ARTICLES, *C.PREPOSITIONS, *C.AUXILIARIES])}) or (length(trim(w)) > 1 and regexp_matches(trim(w), '^\\p{{Lu}}') and length(trim(nx)) > 1 and regexp_matches(trim(nx), '^\\p{{Lu}}') and a not in ({_list(C.CONJUNCTIONS)})), false) as bad from t) select conv_id, count(*) filter (where good) as good, count(*) filter (where bad) as bad, count(*) as words from f group by 1",
    "cue_pack": f"with recursive {_CUES} select conv_id, turn, pos, words, chars, good, text from cue",
    "cue_pairs": f"with recursive {_PAIRS} select conv_id, turn, event, count(*) as lines, cast(sum(chars) as bigint) as chars from (select c.conv_id, c.turn, c.chars, (select max(ev.event) from ev where ev.conv_id = c.conv_id and ev.turn = c.turn and ev.n <= c.n) as event from cc c) group by 1, 2, 3",
    "attack_release": "with recursive x as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events), r as (select user_id, event_id, n, 1.0::double + case when value < 1 then 0.5::double else 0.1::double end * (value - 1.0::double) as st from x where n = 1 union all select x.user_id, x.event_id, x.n, r.st + case when x.value < r.st then 0.5::double else 0.1::double end * (x.value - r.st) from r join x on x.user_id = r.user_id and x.n = r.n + 1) select event_id, st as smooth from r",
    "hook_gaps": f"with {_WORDS}, h(text, anchor) as (values ('now see', 'the'), ('one two three four five', 'the'), ('never', 'xyzzy')), c as (select distinct conv_id, turn from word), t as (select distinct conv_id, turn, {_TOKEN.format(w='w')} as a from word) select text, error, count(*) as n from (select h.text, case when h.text like 'one%' then 'too long' else 'no such word' end as error from c cross join h where h.text like 'one%' or not exists (select 1 from t where t.conv_id = c.conv_id and t.turn = c.turn and t.a = h.anchor)) group by 1, 2",
    "in_process": "select o_custkey as role, count(*) as n, min(o_orderkey) as id, case when count(*) > 1 then 'ambiguous' else 'again' end as state from orders where o_orderstatus = 'P' group by 1",
    "cue_islands": f"with {_ISLE} select conv_id, turn, cast(island as bigint) as island, words, chars, s, e from isle",
    "cue_audit": f"with {_ISLE}, p as (select *, chars / (e - s) as pace, e - s as dur from isle) select conv_id, turn, pos, case when pace > 12.5 then 'fail' else 'warn' end as severity, 'pace' as rule from p where pace > 11.5 union all select conv_id, turn, pos, 'warn', 'short' from p where dur < 0.83",
    "event_timing": f'with {_TIMES} select conv_id, turn, pos, round(stop, 6) as "end" from te',
    "subtitle_lines": f"with {_TIMES}, f as (select *, cast(floor(s) as bigint) as a, cast(floor(stop) as bigint) + 1 as b from te) select conv_id, turn, pos, printf('Dialogue: 0,%d:%02d:%02d.00,%d:%02d:%02d.00,Karaoke,,0,0,0,,cue\\N%d', a // 3600, a % 3600 // 60, a % 60, b // 3600, b % 3600 // 60, b % 60, pos) as line from f",
    "first_anchor": f"with d as (select doc_id, unnest(string_split_regex(text, '\\s+')) as w, generate_subscripts(string_split_regex(text, '\\s+'), 1) - 1 as pos from documents), f as (select doc_id, {_TOKEN.format(w='w')} as token, min(pos) as pos from d group by 1, 2), b as (select item_id, {_TOKEN.format(w=chr(115) + 'tring_split_regex(text, ' + chr(39) + chr(92) + 's+' + chr(39) + ')[1]')} as token from benchmark) select doc_id, item_id, pos from f join b using (token)",
    "locale_rewrite": f"with t as (select o_orderkey, o_orderkey % 1440 // 60 as h, o_orderkey % 60 as m, cast(floor(o_totalprice) as bigint) as p from orders) select o_orderkey, 'a las ' || {_CLOCK} || ' vale ' || p || '.5 euros' as latam, 'a las ' || h || ':' || lpad(cast(m as varchar), 2, '0') || ' vale ' || p || ',5 euros' as spain from t",
    "scenario_expand": f"with {_SCENARIOS} select feature, scenario_index, example_index, name, case when flag = 'N' then 2 else 3 end as steps from ex",
    "placeholder_fill": "select n_nationkey, 'nation ' || n_name || ' of ' || r_name || ', again ' || n_name as text from nation join region on n_regionkey = r_regionkey",
    "first_match_route": f"with {_SCENARIOS} select feature, scenario_index, example_index, 0 as step, 'a shop' as text, 'shop' as handler from ex union all select feature, scenario_index, example_index, 1, case when flag = 'N' then 'nothing happens' else 'part ' || part || ' moves' end, case when flag = 'N' then 'unsupported' else 'part' end from ex union all select feature, scenario_index, example_index, 2, 'flag ' || shown || ' shows', case when shown = 'X' then 'any_flag' else 'flag' end from ex where flag <> 'N'",
    "spec_violations": "select event_id, case event_id % 7 when 0 then 'pct' when 1 then 'easing' when 2 then 'colour' when 4 then 'center' else 'x' end as arg, case event_id % 7 when 0 then 'not a number' when 1 then 'not a choice' when 2 then 'unknown argument' when 4 then 'not a point' else 'unknown command' end as error from events where event_id % 7 in (1, 2, 4, 5) or event_id % 7 = 0 and value > 50",
    "message_violations": """select o_orderkey, array_to_string(list_concat(list_concat(case o_orderkey % 7 when 4 then ['type missing', 'to missing'] when 5 then ['type unknown'] else [] end, case when o_orderkey % 120 between 10 and 99 then [] else ['priority not two digits'] end),
 case o_orderkey % 7 when 1 then ['recipient twice', 'message too long'] when 3 then ['recipient unknown', 'commit not ten hex digits', 'task missing'] when 5 then ['recipient has underscore', 'recipient unknown'] when 6 then ['header not allowed'] else [] end), '; ') as errors from orders""",
    "unknown_keys": "select event_type as key, count(*) as n from events where event_type <> 'view' group by 1",
    "mastering_chain": "select event_id, 'dc_block>highpass' || case when i % 2 = 1 then '>dehum' else '' end || case when i // 2 % 2 = 0 then '>eq>deesser' else '' end || case when i // 4 % 2 = 0 then '>compressor' else '' end || case when i // 8 % 2 = 0 then '>limiter' else '' end || '>loudness' as stages from (select event_id, event_id % 16 as i from events)",
    "beat_timeline": """with d as (select event_id as id, (event_id % 80 + 1) / 2.0::double as d from events), h as (select *, least(0.7, d) as hook, case when d <= 10 then greatest(0, d - 0.8) when d <= 30 then greatest(0, d - 1.5) else greatest(0, d - 2) end as card from d),
p as (select *, least(2.5, greatest(hook + 0.1, d * 0.18)) as promise from h), q as (select *, greatest(promise, d - 1) as short, least(8, greatest(promise + 0.5, d * 0.38)) as proof from p), r as (select *, greatest(proof, card) as last from q),
b as (select id, 0.0::double as a, hook as z, 'hook' as beat from r union all select id, hook, promise, 'promise' from r where d > 1 union all select id, promise, short, 'proof' from r where d > 1 and d <= 8 union all select id, short, d, 'payoff' from r where d > 1 and d <= 8
  union all select id, promise, proof, 'proof' from r where d > 8 union all select id, proof, last, 'progression' from r where d > 8 union all select id, last, d, 'payoff_cta' from r where d > 8)
select id, round(a, 6) as start_s, round(z, 6) as end_s, beat from b where z > a""",
    "fanout": f"with {_MSG}, e as (select id, unnest(string_split(to_, ',')) as recipient from ord where to_ not like '%X%') select id, recipient from e",
    "dead_letters": f'with {_MSG} select id, to_ as "to" from ord where to_ like \'%X%\'',
    "queue_next": f"with {_MSG} select role, id, priority from ord qualify row_number() over (partition by role order by priority, created, id) = 1",
    "queue_batch": f"with {_MSG} select role, id from ord qualify priority = min(priority) over (partition by role)",
    "queue_latency": "with d as (select l_orderkey, max(l_shipdate) as done from lineitem group by 1), x as (select o_orderpriority, date_diff('day', o_orderdate, done) as days from orders join d on o_orderkey = l_orderkey) select o_orderpriority, count(*) as n, min(days) as least, max(days) as most, cast(sum(days) as bigint) as total from x group by 1",
    "queue_sequence": "select o_orderkey as id, printf('%06d', row_number() over (order by o_orderdate, o_orderkey)) as number from orders",
    "queue_advance": """with d as (select l_orderkey as id, max(l_shipdate) as ended from lineitem where l_linenumber > 1 group by 1), q as (select o_orderkey as id, o_custkey as role, substr(o_orderpriority, 1, 1) as priority, o_orderdate as created, case when o_orderstatus = 'F' then o_orderdate end as dq, case when o_orderstatus = 'F' then d.ended end as cp from orders left join d on d.id = o_orderkey),
f as (select *, bool_or(dq is not null and cp is null) over (partition by role) as busy, case when dq is null then row_number() over (partition by role, dq is null order by priority, created, id) end as n from q)
select id, role, strftime(case when not busy and n = 1 then timestamp '2030-01-01' else dq end, '%Y-%m-%d') as dequeued, strftime(cp, '%Y-%m-%d') as completed from f""",
    "batch_texts": "with n as (select *, row_number() over (partition by s_nationkey order by s_suppkey) as k, count(*) over (partition by s_nationkey) as n from supplier) select s_nationkey, string_agg('[' || k || '/' || n || ']' || chr(10) || 'to: ' || s_name, chr(10) || chr(10) order by k) as text from n group by 1",
    "mailbox_files": "select '1_20240506T070809Z_' || printf('%06d', s_suppkey + 999990) || '_from_clerk_to_n' || s_nationkey as name, s_suppkey::varchar as id, 'n' || s_nationkey as recipient, s_name as body from supplier",
    "sorted_medians": "select l_partkey, round(median(l_extendedprice), 6) as median from lineitem group by 1",
    "header_parse": f"with {_MSG} select id, '0' || priority as priority, 3 as headers, 'body ' || id as body from ord",
    "cosine_pairs": "select a.vec_id as a, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "vote_preference": f"with {_VOTES}, w as (select pair, case side when 'a' then a when 'b' then b else 'tie' end as won, count(*) as n from vs group by 1, 2) select pair, won, n, round(n / sum(n) over (partition by pair), 6) as share from w",
    "vote_mos": f"with {_VOTES} select condition, count(*) as n, round(avg(mos), 6) as mos from (select a as condition, ma as mos from vs union all select b, mb from vs) where mos is not null group by 1",
    "manifest_hash": "select substr(sha256(string_agg(m, chr(10) order by m)), 1, 16) as fingerprint from (select p_name || '/' || p_partkey || ':' || p_size as m from part)",
    "catalog_search": "select p_partkey, p_name, p_retailprice from part where p_name like '%ring%' and p_type in ('ECONOMY', 'SMALL') and p_size between 5 and 40 order by p_retailprice desc, p_partkey limit 25 offset 25",
    "stream_sessions": "with e as (select user_id, epoch_us(ts) as us from events), g as (select *, case when us - lag(us) over (partition by user_id order by us) < 21600000000 then 0 else 1 end as fresh from e), s as (select *, sum(fresh) over (partition by user_id order by us rows unbounded preceding) as s from g) select user_id, min(us) as start_us, max(us) + 21600000000 as end_us, count(*) as events from s group by user_id, s",
    "stream_queue": f"with {_MSG}, e as (select id, unnest(string_split(to_, ',')) as recipient from ord where to_ not like '%X%') select id, recipient from e",
}
