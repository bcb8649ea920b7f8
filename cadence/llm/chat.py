"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets the dialogue rendered with that speaker as the assistant, all
others as users with their names and system turns as they are, and the spans of characters to train on: what
the assistant says and its end mark. Built-in functions only. One conversation may be a third of all rows, so a dialogue of more than ``most`` turn
numbers comes in parts of that many, each led by the conversation's first system turn; nothing gathers a conversation in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rendered format; a mark's first two characters inside a text are set apart.
BEGIN, END, SYSTEM = "<|im_start|>", "<|im_end|>\n", "system"
TURNS = 256


def rotate(turns: DataFrame, most: int = TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conversation, participant, part, n_turns, text, mask and n_trained for every participant and part.

    mask: "start:end" of each trained span, code points from the part's beginning, joined by commas (empty
    if the participant does not speak in that part); n_trained: their sum. Part k has turn numbers k*most and
    on, n_turns of them; the conversation's first system turn (of several with that number the first by text) leads every part
    that does not have it. Null turns are the parts before the first with a negative number, or before 0: as many as hold about most each, dealt by a hash of speaker and text.
    Equal turn numbers are ordered by speaker and text; repeated rows are rendered
    as often as they are there. A null role is the speaker ``unknown``, a null text empty; rows with a null
    conversation are one conversation. A conversation of system turns only, or an empty table, gives no rows;
    other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    )
    nulls = rows.filter("turn is null").groupBy(F.col("conv").alias("of")).agg(F.ceil(F.count("*") / most).alias("buckets"))
    low = rows.filter("turn < 0").groupBy(F.col("conv").alias("under")).agg(F.floor(F.min("turn") / F.lit(most)).cast("long").alias("low"))
    nulls = nulls.join(low, nulls["of"].eqNullSafe(low["under"]), "left").select("of", "buckets", F.coalesce("low", F.lit(0)).alias("low"))
    rows = rows.join(nulls, rows["conv"].eqNullSafe(nulls["of"]), "left").drop("of")
    dealt = F.conv(F.substring(F.md5(F.concat("speaker", F.lit("\n"), "said")), 1, 8), 16, 10).cast("long") % F.col("buckets")
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / F.lit(most)).cast("long"), F.col("low") - 1 - dealt)).drop("buckets", "low")
    who = rows.filter(F.col("speaker") != SYSTEM).select(F.col("conv").alias("of"), F.col("speaker").alias("participant")).distinct()
    told = rows.filter((F.col("speaker") == SYSTEM) & F.col("turn").isNotNull()).groupBy(F.col("conv").alias("told")).agg(F.min(F.struct("turn", "said", "part")).alias("s"))
    lead = told.select("told", F.col("s.part").alias("lead_part"), F.concat(F.lit(f"{BEGIN}system\n"), F.col("s.said"), F.lit(END)).alias("lead"))
    seen = rows.join(who, rows["conv"].eqNullSafe(who["of"])).drop("of")
    own = F.col("speaker") == F.col("participant")
    head = F.when(own, F.lit(f"{BEGIN}assistant\n")).when(F.col("speaker") == SYSTEM, F.lit(f"{BEGIN}system\n")).otherwise(F.concat(F.lit(f"{BEGIN}user name="), "speaker", F.lit("\n")))
    order = Window.partitionBy("conv", "participant", "part").orderBy("turn", "speaker", "said")
    seen = seen.withColumn("head", head).withColumn("piece", F.concat("head", "said", F.lit(END)))
    seen = seen.withColumn("at", F.row_number().over(order)).withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = seen.groupBy("conv", "participant", "part").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", "piece", F.when(own, F.struct((F.col("end") - F.length("piece") + F.length("head")).alias("a"), F.col("end").alias("b"))).alias("span")))).alias("pieces"),
        F.sum(F.when(own, F.length("piece") - F.length("head")).otherwise(0)).cast("long").alias("n_trained"),
    )
    grouped = grouped.join(lead, grouped["conv"].eqNullSafe(lead["told"]), "left").withColumn("lead", F.when(F.col("lead_part") != F.col("part"), F.col("lead")).otherwise(""))
    shift = F.length(F.coalesce("lead", F.lit("")))
    spans = F.transform(F.filter("pieces.span", lambda x: x.isNotNull()), lambda x: F.concat((x["a"] + shift).cast("string"), F.lit(":"), (x["b"] + shift).cast("string")))
    return grouped.select(
        F.col("conv").alias(conv_col), "participant", "part", "n_turns",
        F.concat(F.coalesce("lead", F.lit("")), F.array_join(F.col("pieces.piece"), "")).alias("text"),
        F.array_join(spans, ",").alias("mask"),
        "n_trained",
    )


#: The same rows in DuckDB's SQL.
ORACLE = f"""
with r as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '< |') as said
  from conversations),
b as (select conv_id as of_conv, ceil(count(*) filter (where turn is null) / {TURNS}.0) as buckets, cast(least(0, coalesce(floor(min(turn) / {TURNS}.0), 0)) as bigint) as low from r group by 1),
t as (
  select r.*, coalesce(cast(floor(turn / {TURNS}.0) as bigint), low - 1 - cast(('0x' || substr(md5(speaker || chr(10) || said), 1, 8))::bigint % buckets as bigint)) as part
  from r left join b on conv_id is not distinct from of_conv),
w as (select distinct conv_id as of_conv, speaker as participant from t where speaker <> '{SYSTEM}'),
y as (
  select conv_id as told, part as lead_part, '{BEGIN}system' || chr(10) || said || '<|im_end|>' || chr(10) as lead
  from (select *, row_number() over (partition by conv_id order by turn, said) as k from t where speaker = '{SYSTEM}' and turn is not null) where k = 1),
s as (
  select t.*, participant, speaker = participant as own,
         case when speaker = participant then '{BEGIN}assistant' || chr(10) when speaker = '{SYSTEM}' then '{BEGIN}system' || chr(10)
              else '{BEGIN}user name=' || speaker || chr(10) end as head,
         case when lead_part <> part then lead else '' end as before
  from t join w on t.conv_id is not distinct from w.of_conv left join y on t.conv_id is not distinct from y.told),
p as (select *, head || said || '<|im_end|>' || chr(10) as piece from s),
o as (
  select *, row_number() over v as at_row, length(coalesce(before, '')) + sum(length(piece)) over (partition by conv_id, participant, part order by turn nulls first, speaker, said rows unbounded preceding) as stop
  from p window v as (partition by conv_id, participant, part order by turn nulls first, speaker, said))
select conv_id, participant, part, count(*) as n_turns, coalesce(any_value(before), '') || string_agg(piece, '' order by at_row) as text,
       coalesce(string_agg(case when own then cast(stop - length(piece) + length(head) as varchar) || ':' || cast(stop as varchar) end, ',' order by at_row), '') as mask,
       cast(coalesce(sum(case when own then length(piece) - length(head) else 0 end), 0) as bigint) as n_trained
from o group by conv_id, participant, part
"""
