"""Queries of the content-metrics family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import metrics as M
from cadence.session import table

r6 = lambda c: F.round(c, 6)

#: Metric rows of users: counts of event types stand for views, clicks, conversions, follows and likes.
EVENTS_SQL = """
with u as (
  select user_id, cast(sum(case when event_type = 'view' then 1 else 0 end) as double) as views,
    cast(sum(case when event_type = 'click' then 1 else 0 end) as double) as clicks,
    cast(sum(case when event_type = 'purchase' then 1 else 0 end) as double) as conversions,
    cast(sum(case when event_type = 'signup' then 1 else 0 end) as double) as follows,
    cast(sum(case when event_type = 'error' then 1 else 0 end) as double) as likes,
    cast(sum(case when event_type = 'purchase' then cast(round(value * 100) as bigint) else 0 end) as double) / 100 as revenue
  from events group by user_id),
m as (
  select *, case when user_id % 4 = 0 then 'tiktok' when user_id % 4 = 1 then 'instagram_reels' when user_id % 4 = 2 then 'youtube_shorts' end as platform,
    case when user_id % 5 = 0 then null else 'topic' || (user_id % 5) end as topic
  from u),
d as (
  select *, follows / nullif(views, 0) as follow_rate, likes / nullif(views, 0) as like_rate, likes / nullif(views, 0) as engagement_rate,
    clicks / nullif(views, 0) as click_rate, conversions / nullif(clicks, 0) as conversion_rate_click,
    conversions / nullif(views, 0) as conversion_rate_view, revenue / nullif(views, 0) as revenue_per_view, revenue / nullif(conversions, 0) as revenue_per_conversion
  from m),
s as (select *, case when follow_rate is null and conversion_rate_click is null then null
        else (coalesce(follow_rate, 0) + coalesce(conversion_rate_click, 0)) / ((follow_rate is not null)::int + (conversion_rate_click is not null)::int) end as goal_score from d)
"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, derived and scored metric rows, one a user."""
    e = table(spark, sf_dir, "events")
    count = lambda t: F.count_if(F.col("event_type") == t).cast("double")
    u = e.groupBy("user_id").agg(
        count("view").alias("views"), count("click").alias("clicks"), count("purchase").alias("conversions"), count("signup").alias("follows"), count("error").alias("likes"),
        (F.sum(F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long")).otherwise(0)) / 100).cast("double").alias("revenue"),
    )
    kind = F.col("user_id") % 4
    u = u.withColumn("platform", F.when(kind == 0, "tiktok").when(kind == 1, "instagram_reels").when(kind == 2, "youtube_shorts"))
    u = u.withColumn("topic", F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("topic"), (F.col("user_id") % 5).cast("string"))))
    for c in M.CANONICAL:
        if c not in u.columns:
            u = u.withColumn(c, F.lit(None).cast("boolean" if c == "captioned" else "string" if c in M.TEXTS else "double"))
    return M.score(M.derive(u))


RATES = "follow_rate like_rate engagement_rate click_rate conversion_rate_click conversion_rate_view revenue_per_view revenue_per_conversion".split()


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).select("user_id", "views", "clicks", "conversions", "follows", "revenue", *[r6(F.col(c)).alias(c) for c in RATES])


def goal_score_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).select("user_id", r6("goal_score").alias("goal_score"))


def metrics_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.summarize(users(spark, sf_dir), ["platform", "topic"], ["goal_score", "views", "follow_rate", "conversion_rate_click"])
    return out.select("dimension", "label", "n", "scored", *[r6(F.col(c)).alias(c) for c in out.columns[4:]])


def insight_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.insights(users(spark, sf_dir)).withColumn("value", r6("value"))


def quality_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.warnings(users(spark, sf_dir).withColumn("id", F.concat(F.lit("u"), (F.col("user_id") % 100).cast("string"))))


def missing_for_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.missing_for_goal(users(spark, sf_dir), "all")


def cross_group_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = users(spark, sf_dir).filter("platform is not null").groupBy("platform").agg(F.median("goal_score").alias("score"), F.count("*").alias("n"))
    return M.rank(by, "score", "platform", 1).select("side", "platform", r6("score").alias("score"), "n")


def rank_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    held = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "o_totalprice")
    return M.rank(held, "o_totalprice", "o_orderkey").select("side", "place", "o_orderkey", "c_name", "o_totalprice")


def retention_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of users that reach their 10th, 40th and 60th event, and the loss between."""
    n = table(spark, sf_dir, "events").groupBy("user_id").count()
    reach = n.agg(*[F.avg((F.col("count") >= k).cast("double")).alias(f"r{k}") for k in (10, 40, 60)])
    return reach.select(*[r6(f"r{k}").alias(f"r{k}") for k in (10, 40, 60)], r6(F.col("r10") - F.col("r60")).alias("loss"))


def quality_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return M.null_counts(docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left"), ["doc_id", "lang", "source", "n_chars", "quality", "toxic"])


def quality_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"))
    return M.duplicates(docs, "digest")


def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest date of each status, compared as texts."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return o.groupBy("o_orderstatus").agg(F.min("d").alias("date_min"), F.max("d").alias("date_max"))


# What people write before and after a number, or instead of one (None).
NUMBERS = [("", "%"), ("", ",5"), ("-", ",250"), ("  ", "  "), ("", ".234,5"), ("", "K"), ("about ", " views"), ("n/a", None), ("-", None), ("", "e1"), ("1,", ",567"), ("", None), ("", " 000"), ("+", ".5"), ("12-", "")]
DURATIONS = [("1:", ":03"), ("", ":30"), ("", ""), ("a:", ""), ("0:0.", ""), ("1:2:", ":4"), ("", " s"), (":", "")]
BOOLS = ["true", "SI", "Sí", "on", "0", "off", "maybe", "", " No ", "1"]
PLATFORMS = ["TikTok", "Douyin", "Instagram", "IG Reels", "YouTube Shorts", "  Vimeo ", "", "facebook"]


def _spelt(key: str, number: Column, forms: list[tuple[str, str | None]]) -> Column:
    """A number between what stands before and after it, by the key's rest."""
    out = F.lit(None).cast("string")
    for k, (before, after) in enumerate(forms):
        out = F.when(F.col(key) % len(forms) == k, F.lit(before) if after is None else F.concat(F.lit(before), number.cast("string"), F.lit(after))).otherwise(out)
    return out


def _spelt_sql(key: str, number: str, forms: list[tuple[str, str | None]]) -> str:
    each = " ".join(f"when {k} then '{before}'" + ("" if after is None else f" || {number} || '{after}'") for k, (before, after) in enumerate(forms))
    return f"case {key} % {len(forms)} {each} end"


def _word(key: str, words: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(key) % len(words) + 1).cast("int"))


def _word_sql(key: str, words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][{key} % {len(words)} + 1]"


NUMBER_SQL = r"""
with a as (select {keep}, trim(v) as t0, lower(trim(v)) in ('', 'na', 'n/a', 'null', '-', '—', 'none') as nothing, trim(v) like '%\%' escape '\' as pct from {source}),
b as (select *, regexp_replace(regexp_replace(t0, '%$', ''), '[\x{{00a0}} ]', '', 'g') as t1 from a),
c as (select *, case when contains(t1, ',') and not contains(t1, '.') and regexp_matches(t1, '^-*[0-9]+,[^,]{{3}}$') then replace(t1, ',', '')
   when contains(t1, ',') and not contains(t1, '.') then replace(t1, ',', '.') when contains(t1, ',') then replace(t1, ',', '') else t1 end as t2 from b),
d as (select *, regexp_replace(t2, '[^0-9eE+.\-]', '', 'g') as t3 from c),
n as (select *, case when nothing then null when regexp_matches(t3, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(t3 as double) end as number from d)
"""


def parse_number_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of orders as people write them."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.parse_number(_spelt("o_orderkey", F.floor("o_totalprice").cast("long"), NUMBERS)).alias("number"))


def parse_rate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of line items written with thousands commas or as percentages, read again."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.format_number(F.floor(cents / 100), 0)).otherwise(F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")))
    return l.select(S.parse_rate(shown).alias("rate")).groupBy("rate").agg(F.count("*").alias("n")).select(r6("rate").alias("rate"), "n").groupBy("rate").agg(F.sum("n").alias("n"))


def parse_duration_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as clocks and seconds."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.parse_duration(_spelt("p_partkey", F.col("p_size"), DURATIONS)).alias("seconds"))


def parse_bool_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for yes and no, in capitals where the order is finished."""
    w = _word("o_orderkey", BOOLS)
    o = table(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderstatus") == "F", F.upper(w)).otherwise(w))
    return o.select("o_orderkey", S.parse_bool(F.col("v")).alias("flag"), S.as_bool(F.col("v")).alias("lenient"))


def platform_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of platforms, some with a part's brand behind them."""
    w = _word("p_partkey", PLATFORMS)
    p = table(spark, sf_dir, "part").withColumn("v", F.when(F.col("p_size") > 25, F.concat(w, F.lit(" "), "p_brand")).otherwise(w))
    return p.select("p_partkey", S.platform(F.col("v")).alias("platform"))


def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parts, with the accents and signs that people put in, as keys."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.normalize_key(F.concat(F.lit("  Ñandú % "), "p_name", F.lit(" / "), "p_brand", F.lit("--"), "p_type", F.lit(" "))).alias("key"))


def slug_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.slug(F.regexp_replace("url", "^https?://", "")).alias("slug"))


def flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ragged JSON column by its keys: the first alias that is there wins."""
    from cadence.sources.records import pick

    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_type", S.parse_number(pick("m", ["key", "k", "kk"])).alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


def format_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.format_num(F.col("p_size") * 1.0).alias("size"), S.format_pct(F.col("p_size") / F.lit(63.0)).alias("share"), S.format_num(F.col("p_size") * F.lit(128.0)).alias("big"))


QUERIES = {f.__name__: f for f in (metric_rows, goal_score_by_user, metrics_group_summary, insight_rules, quality_warnings, missing_for_goal, cross_group_best_worst, rank_top_bottom, retention_drop, quality_nulls, quality_duplicates, date_bounds, parse_number_cases, parse_rate_cases, parse_duration_cases, parse_bool_cases, platform_norm, normalize_keys, slug_urls, flatten_props, format_cases)}

_PICK = "round(follow_rate, 6) as follow_rate, round(like_rate, 6) as like_rate, round(engagement_rate, 6) as engagement_rate, round(click_rate, 6) as click_rate, round(conversion_rate_click, 6) as conversion_rate_click, round(conversion_rate_view, 6) as conversion_rate_view, round(revenue_per_view, 6) as revenue_per_view, round(revenue_per_conversion, 6) as revenue_per_conversion"
_GROUP = ", ".join(f"round(median({m}), 6) as median_{m}, round(avg({m}), 6) as mean_{m}" for m in ("goal_score", "views", "follow_rate", "conversion_rate_click"))

ORACLES = {
    "metric_rows": EVENTS_SQL + f"select user_id, views, clicks, conversions, follows, revenue, {_PICK} from d",
    "goal_score_by_user": EVENTS_SQL + "select user_id, round(goal_score, 6) as goal_score from s",
    "metrics_group_summary": EVENTS_SQL
    + " union all ".join(f"select '{d}' as dimension, coalesce({d}, 'unknown') as label, count(*) as n, count(goal_score) as scored, {_GROUP} from s group by {d}" for d in ("platform", "topic")),
    "insight_rules": EVENTS_SQL
    + """, p as (select platform as p, count(*) as n, median(goal_score) as score from s where platform is not null group by platform),
hl as (select (select struct_pack(p := p, score := score, n := n) from p order by coalesce(nullif(score, 0), -1) desc, p desc limit 1) as hi,
  (select struct_pack(p := p, score := score, n := n) from p order by coalesce(nullif(score, 0), -1), p limit 1) as lo)
select 1 as ordinal, 'ranking' as insight, 'all' as subject, round(max(goal_score) - min(goal_score), 6) as value, case when count(goal_score) >= 20 then 'high' when count(goal_score) >= 8 then 'medium' else 'low' end as confidence, '' as detail from s having count(goal_score) >= 3
union all select 2, 'platform', 'cross_platform', round(hi.score - lo.score, 6), case when hi.n + lo.n >= 20 then 'high' when hi.n + lo.n >= 8 then 'medium' else 'low' end, hi.p || ' > ' || lo.p from hl where (select count(*) from p) >= 2
union all select 5, 'missing_data', 'data_quality', 4.0, 'preliminary', 'duration_s,average_watch_time_s,shares,saves'""",
    "quality_warnings": EVENTS_SQL
    + "select 'duplicate_ids' as code from s having count(*) > count(distinct user_id % 100) union all select 'several_platforms' from s having count(distinct coalesce(platform, 'unknown')) > 1 union all select 'no_watch_time'",
    "missing_for_goal": EVENTS_SQL + "select f.field, cast(0 as bigint) as present, (select count(*) from s) as total from (values ('duration_s'), ('average_watch_time_s'), ('shares'), ('saves')) f(field)",
    "cross_group_best_worst": EVENTS_SQL
    + """, g as (select platform, median(goal_score) as score, count(*) as n from s where platform is not null group by platform)
(select 'top' as side, platform, round(score, 6) as score, n from g order by g.score desc, platform limit 1) union all (select 'bottom', platform, round(score, 6), n from g order by g.score, platform desc limit 1)""",
    "rank_top_bottom": """with h as (select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey),
r as (select *, row_number() over (order by o_totalprice desc, o_orderkey) as a, row_number() over (order by o_totalprice, o_orderkey desc) as b from h)
select 'top' as side, a as place, o_orderkey, c_name, o_totalprice from r where a <= 5 union all select 'bottom', b, o_orderkey, c_name, o_totalprice from r where b <= 5""",
    "retention_drop": """with n as (select user_id, count(*) as c from events group by user_id), r as (select avg(case when c >= 10 then 1.0 else 0 end) as r10, avg(case when c >= 40 then 1.0 else 0 end) as r40, avg(case when c >= 60 then 1.0 else 0 end) as r60 from n)
select round(r10, 6) as r10, round(r40, 6) as r40, round(r60, 6) as r60, round(r10 - r60, 6) as loss from r""",
    "quality_nulls": """with j as (select quality, toxic from documents left join labels using (doc_id)) select 'quality' as field, count(*) as missing from j where quality is null having count(*) > 0 union all select 'toxic', count(*) from j where toxic is null having count(*) > 0""",
    "quality_duplicates": "select sha256(text) as digest, count(*) as n from documents group by 1 having count(*) > 1",
    "date_bounds": "select o_orderstatus, min(strftime(o_orderdate, '%Y-%m-%d')) as date_min, max(strftime(o_orderdate, '%Y-%m-%d')) as date_max from orders group by 1",
    "parse_number_cases": NUMBER_SQL.format(keep="o_orderkey", source="(select o_orderkey, " + _spelt_sql("o_orderkey", "cast(floor(o_totalprice) as bigint)", NUMBERS) + " as v from orders)") + "select o_orderkey, number from n",
    "parse_rate_cases": """with x as (select case when l_linenumber % 2 = 0 then round(cast(round(l_extendedprice * 100) as bigint) // 100 / 1.0, 0) else null end as big, l_discount from lineitem),
y as (select case when big is null then round(round(l_discount * 100) / 100.0, 6) when big > 1 then round(big / 100.0, 6) else big end as rate from x)
select rate, count(*) as n from y group by rate""",
    "parse_duration_cases": "select p_partkey, cast(case p_partkey % 8 when 0 then 3603 + p_size * 60 when 1 then p_size * 60 + 30 when 4 then cast('0.' || p_size as double) when 5 then cast('12' || p_size || '4' as double) else p_size end as double) as seconds from part",
    "parse_bool_cases": f"with w as (select o_orderkey, case when o_orderstatus = 'F' then upper({_word_sql('o_orderkey', BOOLS)}) else {_word_sql('o_orderkey', BOOLS)} end as v from orders) select o_orderkey, case when lower(trim(v)) in ('true', 'yes', 'si', 'sí', '1', 'on') then true when lower(trim(v)) in ('false', 'no', '0', 'off') then false end as flag, lower(trim(v)) in ('true', 'yes', 'si', 'sí', '1', 'on') as lenient from w",
    "platform_norm": f"with w as (select p_partkey, {_word_sql('p_partkey', PLATFORMS)} || case when p_size > 25 then ' ' || p_brand else '' end as v from part) select p_partkey, case when lower(v) like '%tiktok%' or lower(trim(v)) = 'douyin' then 'tiktok' when lower(v) like '%instagram%' or lower(v) like '%reels%' then 'instagram_reels' when lower(v) like '%youtube%' or lower(v) like '%shorts%' then 'youtube_shorts' else nullif(lower(trim(v)), '') end as platform from w",
    "normalize_keys": "select p_partkey, 'nandu_' || regexp_replace(lower(p_name || '_' || p_brand || '_' || p_type), '[^a-z0-9]+', '_', 'g') as key from part",
    "slug_urls": r"select page_id, trim(regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^\p{L}\p{N}]+', '-', 'g'), '-') as slug from pages",
    "flatten_props": "select event_type, count(props->>'k') as n, sum(cast(props->>'k' as double)) as total, max(cast(props->>'k' as double)) as top from events group by event_type",
    "format_cases": """select p_partkey, case when p_size >= 10 then printf('%.1f', p_size * 1.0) else printf('%.3f', p_size * 1.0) end as size, printf('%.1f%%', p_size / 63.0 * 100) as share,
case when p_size * 128 >= 1000 then format('{:,}', p_size * 128) else printf('%.1f', p_size * 128.0) end as big from part""",
}
