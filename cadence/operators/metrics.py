"""Content metrics: typed rows, derived rates, goal scores, grouped summaries, quality and ranked insights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import scalars as S

# Canonical columns by kind, dimensions, metrics of a summary, metrics of each goal and what a goal needs.
NUMERIC = "duration_s views reach impressions watch_time_s average_watch_time_s engaged_views likes comments shares saves follows clicks conversions revenue spend".split()
RATES = "average_percentage_viewed completion_rate stayed_to_watch_rate retention_2s retention_3s retention_6s retention_25 retention_50 retention_75 retention_100".split()
TEXTS = "id platform date period organic_or_ads country language audience topic hook_type edit_style audio_type cta experiment_id variable_changed".split()
CANONICAL = [*TEXTS, "captioned", *NUMERIC, *RATES]
DIMENSIONS = "platform topic hook_type edit_style audio_type captioned experiment_id".split()
SUMMARY = "goal_score views average_watch_time_s completion_proxy completion_rate retention_2s retention_6s like_rate comment_rate share_rate save_rate follow_rate engagement_rate click_rate conversion_rate_click conversion_rate_view".split()
GOALS = {
    "retention": "completion_proxy completion_rate average_percentage_viewed stayed_to_watch_rate retention_2s retention_6s".split(),
    "engagement": "share_rate save_rate comment_rate follow_rate like_rate".split(),
    "conversion": "conversion_rate_click conversion_rate_view click_rate".split(),
    "creative": "completion_proxy share_rate save_rate engagement_rate".split(),
    "all": "completion_proxy retention_2s share_rate save_rate follow_rate conversion_rate_click".split(),
}
NEEDS = {
    "retention": "views duration_s average_watch_time_s completion_rate retention_2s".split(),
    "engagement": "views likes comments shares saves".split(),
    "conversion": "views reach clicks conversions".split(),
    "creative": "views duration_s topic hook_type edit_style audio_type".split(),
    "cross-platform": "platform views reach average_watch_time_s".split(),
    "all": "platform views duration_s average_watch_time_s shares saves".split(),
}


def typed(raw: DataFrame) -> DataFrame:
    """Canonical columns from text columns of the same names (absent ones are null); other columns stay."""
    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")

    columns = [F.trim(text(c)).alias(c) for c in TEXTS if c != "platform"]
    columns.append(S.platform(text("platform")).alias("platform"))
    columns.append(S.parse_bool(text("captioned")).alias("captioned"))
    columns += [(S.parse_duration if c == "duration_s" else S.parse_number)(text(c)).alias(c) for c in NUMERIC]
    columns += [S.parse_rate(text(c)).alias(c) for c in RATES]
    return raw.select(*[c for c in raw.columns if c not in CANONICAL], *columns)


def derive(rows: DataFrame) -> DataFrame:
    """Rates of typed rows. Zero views fall through to reach, then impressions; engagement counts null as nothing."""
    c = F.col
    base = S.first_nonzero(c("views"), c("reach"), c("impressions"))
    click_base = S.first_nonzero(c("reach"), c("views"), c("impressions"))
    total = S.ratio(c("watch_time_s"), c("views"))
    zero = lambda n: F.coalesce(c(n), F.lit(0.0))
    return rows.withColumns(
        {"average_watch_time_from_total": total, "completion_proxy": S.ratio(F.coalesce(F.nullif(c("average_watch_time_s"), F.lit(0.0)), total), c("duration_s"))}
        | {f"{n}_rate": S.ratio(c(f"{n}s"), base) for n in ("like", "comment", "share", "save", "follow")}
        | {
            "engagement_rate": S.ratio(zero("likes") + zero("comments") + zero("shares") + zero("saves"), base),
            "value_rate": S.ratio(zero("shares") + zero("saves"), base),
            "click_rate": S.ratio(c("clicks"), click_base),
            "conversion_rate_click": S.ratio(c("conversions"), c("clicks")),
            "conversion_rate_view": S.ratio(c("conversions"), c("views")),
            "revenue_per_view": S.ratio(c("revenue"), c("views")),
            "revenue_per_conversion": S.ratio(c("revenue"), c("conversions")),
        }
    )


def score(rows: DataFrame, goal: str = "all") -> DataFrame:
    """goal_score: mean of the goal's finite metrics; an unknown goal scores as ``all``."""
    return rows.withColumn("goal_score", S.mean_of(*[F.col(m) for m in GOALS.get(goal, GOALS["all"])]))


def summarize(rows: DataFrame, dimensions: list[str] = DIMENSIONS, metrics: list[str] = SUMMARY) -> DataFrame:
    """(dimension, label, n, scored, median_*, mean_*) for every value of every single dimension.

    One pass: a row is given out once for each dimension, grouped once. Null and empty labels are ``unknown``.
    """
    label = lambda d: F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit("unknown"))
    spread = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), label(d).alias("label")) for d in dimensions]))
    held = rows.select(*[S.finite(F.col(m)).alias(m) for m in metrics], spread.alias("at")).select(*metrics, "at.dimension", "at.label")
    parts = [F.count("*").alias("n"), F.count("goal_score").alias("scored")]
    for m in metrics:
        parts += [F.median(m).alias(f"median_{m}"), F.avg(m).alias(f"mean_{m}")]
    return held.groupBy("dimension", "label").agg(*parts)


def missing_for_goal(rows: DataFrame, goal: str = "all") -> DataFrame:
    """(field, present, total) of the goal's fields that fewer than half of the rows (and fewer than two) have."""
    fields = NEEDS.get(goal, NEEDS["all"])
    counts = rows.agg(F.count("*").alias("total"), *[F.count(F.nullif(F.col(f).cast("string"), F.lit(""))).alias(f) for f in fields])
    long = counts.unpivot("total", fields, "field", "present")
    return long.filter(F.col("present") < F.greatest(F.lit(2), F.ceil(F.col("total") * 0.5))).select("field", "present", "total")


def null_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing) of the fields that any row lacks, in one pass."""
    counts = rows.agg(*[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f) for f in fields])
    return counts.unpivot([], fields, "field", "missing").filter("missing > 0")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of non-empty keys that stand more than once."""
    return rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def warnings(rows: DataFrame) -> DataFrame:
    """(code) of what weakens an analysis of the rows."""
    seen = rows.agg(
        F.count("*").alias("n"), F.count_distinct(F.coalesce("platform", F.lit("unknown"))).alias("platforms"), F.count("views").alias("views"),
        F.count(F.coalesce("average_watch_time_s", "completion_rate")).alias("watch"), F.count(F.nullif("topic", F.lit(""))).alias("topics"),
        (F.count(F.nullif("id", F.lit(""))) - F.count_distinct(F.nullif("id", F.lit("")))).alias("again"),
    )
    rules = [("small_sample", "n < 3"), ("duplicate_ids", "again > 0"), ("several_platforms", "platforms > 1"), ("no_views", "views = 0"), ("no_watch_time", "watch = 0"), ("no_topics", "topics = 0")]
    return seen.select(F.explode(F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(code)) for code, rule in rules]))).alias("code"))


def rank(rows: DataFrame, value: str, tie: str, top: int = 5) -> DataFrame:
    """The best and worst rows: side (top, bottom), place, and the row; equal values in order of the tie column."""
    held = rows.filter(F.col(value).isNotNull())
    best = held.orderBy(F.desc(value), F.asc(tie)).limit(top)
    worst = held.orderBy(F.asc(value), F.desc(tie)).limit(top)
    best = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(value), F.asc(tie)))).withColumn("side", F.lit("top"))
    worst = worst.withColumn("place", F.row_number().over(Window.orderBy(F.asc(value), F.desc(tie)))).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def confidence(n: Column, relative: bool = False) -> Column:
    return F.when(n >= 20, "high").when(n >= 8, "medium").otherwise("low" if relative else "preliminary")


# Fixed: what each insight asks to do, what that should bring, and what to measure then.
NEXT = {
    "ranking": ("repeat what the best have in common and change one thing", "a higher median score", "the goal's metrics of the next variants"),
    "platform": ("compare like pieces by rates and fit opening, captions and mix to each platform", "a higher rate on the weaker platform", "the main rate of each platform and early retention"),
    "early_loss": ("open with the result or the conflict, context later", "higher retention at six seconds", "retention at two and six seconds of two openings over one body"),
    "opening": ("make one variant of the first second and leave the rest", "more who stay, no fewer who finish", "early retention, watch time and completion of the variants"),
    "missing_data": ("ask for the missing fields before anything final", "fewer other explanations", "how complete the asked fields are"),
}


def outcome(found: DataFrame) -> DataFrame:
    """What to do first: the first insight's action, what it should bring, what to measure, how sure; one row, without insights ``insufficient_data``."""
    text = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for name, told in NEXT.items() for x in (name, told[k])]), "insight")
    first = found.groupBy().agg(F.min_by(F.struct("insight", "confidence"), "ordinal").alias("f")).select("f.*")
    return first.select(text(0).alias("priority_action"), text(1).alias("expected_outcome"), text(2).alias("measure_next"), F.coalesce("confidence", F.lit("insufficient_data")).alias("confidence"))


def next_questions(rows: DataFrame, goal: str = "all") -> DataFrame:
    """(ordinal, question, detail): the fields to ask for (five at most, in the goal's order) and what changed at once; with none missing, what was varied."""
    fields = NEEDS.get(goal, NEEDS["all"])
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    gap = missing_for_goal(rows, goal).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "field"))).alias("f"))
    asked = F.array_join(F.slice(F.col("f.field"), 1, 5), ",")
    row = lambda n, q, d: F.struct(F.lit(n).alias("ordinal"), F.lit(q).alias("question"), d.alias("detail"))
    some = F.array(row(1, "fields", asked), row(2, "changes", F.lit("audience,date,audio,hook,spend")))
    none = F.array(row(1, "variable", F.lit(goal)), row(2, "topic", F.lit("retention,hook,engagement,creative_editing,audio_captions,conversion,cross_platform")))
    return gap.select(F.inline(F.when(F.size("f") > 0, some).otherwise(none)))


def input_summary(rows: DataFrame) -> DataFrame:
    """(rows, platforms, date_min, date_max) in one pass; platforms by name, dates as they are written."""
    day = F.nullif(F.col("date").cast("string"), F.lit(""))
    return rows.agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.coalesce(F.nullif("platform", F.lit("")), F.lit("unknown")))).alias("platforms"), F.min(day).alias("date_min"), F.max(day).alias("date_max"))


def insights(rows: DataFrame, goal: str = "all", most: int = 8) -> DataFrame:
    """Rule rows (ordinal, insight, subject, value, confidence, detail): spread of the score, platforms apart, early loss, opening, missing data."""
    spread = rows.agg(F.count("goal_score").alias("n"), F.max("goal_score").alias("best"), F.min("goal_score").alias("worst")).filter("n >= 3")
    frames = [spread.select(F.lit(1).alias("ordinal"), F.lit("ranking").alias("insight"), F.lit(goal).alias("subject"), (F.col("best") - F.col("worst")).alias("value"), confidence(F.col("n"), True).alias("confidence"), F.lit("").alias("detail"))]

    own = rows.withColumn("p", F.coalesce(F.nullif("platform", F.lit("")), F.lit("unknown"))).filter("p <> 'unknown'").groupBy("p").agg(F.count("*").alias("n"), F.median(S.finite(F.col("goal_score"))).alias("score"))
    order = F.struct(F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(-1.0)), "p")
    two = own.agg(F.count("*").alias("k"), F.max_by(F.struct("p", "score", "n"), order).alias("hi"), F.min_by(F.struct("p", "score", "n"), order).alias("lo")).filter("k >= 2 and hi.score is not null and lo.score is not null")
    frames.append(two.select(F.lit(2).alias("ordinal"), F.lit("platform").alias("insight"), F.lit("cross_platform").alias("subject"), (F.col("hi.score") - F.col("lo.score")).alias("value"), confidence(F.col("hi.n") + F.col("lo.n"), True).alias("confidence"), F.concat_ws(" > ", "hi.p", "lo.p").alias("detail")))

    early = rows.agg(F.median(S.finite(F.col("retention_2s"))).alias("r2"), F.median(S.finite(F.col("retention_6s"))).alias("r6"), F.count(S.finite(F.col("retention_2s"))).alias("n"))
    frames.append(early.filter("r2 - r6 > 0").select(F.lit(3).alias("ordinal"), F.lit("early_loss").alias("insight"), F.lit("retention").alias("subject"), (F.col("r2") - F.col("r6")).alias("value"), confidence(F.col("n")).alias("confidence"), F.lit("").alias("detail")))
    frames.append(early.filter("r2 is not null").select(F.lit(4).alias("ordinal"), F.lit("opening").alias("insight"), F.lit("hook").alias("subject"), F.col("r2").alias("value"), confidence(F.col("n")).alias("confidence"), F.lit("").alias("detail")))

    place = F.array_position(F.array(*[F.lit(f) for f in NEEDS.get(goal, NEEDS["all"])]), F.col("field"))
    gap = missing_for_goal(rows, goal).agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct(place.alias("at"), "field"))).alias("f")).filter("k > 0")
    frames.append(gap.select(F.lit(5).alias("ordinal"), F.lit("missing_data").alias("insight"), F.lit("data_quality").alias("subject"), F.col("k").cast("double").alias("value"), F.lit("preliminary").alias("confidence"), F.array_join(F.slice(F.col("f.field"), 1, 6), ",").alias("detail")))
    return reduce(DataFrame.unionByName, frames).orderBy("ordinal").limit(most)
