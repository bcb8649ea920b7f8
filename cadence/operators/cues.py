"""Word-timed text: cues of readable lines, two-line events, reading audits, event times and anchored hooks.

Words are rows (keys, pos, w, s, e) with times in seconds. Packing words into lines looks back inside a line only and
starts anew after a pause, so pauses cut a clip into islands that are packed apart: a long clip is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cadence.functions.scalars import norm_token

# Word classes of Spanish that a line should not end on, or may break before.
ARTICLES = ["el", "la", "los", "las", "un", "una", "unos", "unas"]
PREPOSITIONS = ["a", "ante", "bajo", "cabe", "con", "contra", "de", "desde", "durante", "en", "entre", "hacia", "hasta", "mediante", "para", "por", "según", "sin", "so", "sobre", "tras", "vía"]
CONJUNCTIONS = ["y", "e", "o", "u", "ni", "pero", "sino", "aunque", "porque", "que", "cuando", "mientras", "si", "como", "pues", "además"]
AUXILIARIES = [
    "he", "has", "ha", "hemos", "habéis", "han", "había", "habías", "habíamos", "habíais", "habían", "habré", "habrás", "habrá", "habremos", "habréis", "habrán", "hube", "hubiste", "hubo", "hubimos", "hubisteis", "hubieron",
    "estoy", "estás", "está", "estamos", "estáis", "están", "estaba", "estabas", "estábamos", "estabais", "estaban", "estaré", "estarás", "estará", "estaremos", "estaréis", "estarán",
    "seré", "serás", "será", "seremos", "seréis", "serán", "era", "eras", "éramos", "erais", "eran", "fui", "fuiste", "fue", "fuimos", "fuisteis", "fueron",
    "voy", "vas", "va", "vamos", "vais", "van", "iba", "ibas", "íbamos", "ibais", "iban", "iré", "irás", "irá", "iremos", "iréis", "irán", "no", "tampoco", "nunca", "jamás",
]
ENDINGS = ".,!?;:"
#: Pause that ends a line, characters of a line, and of each line of a pair.
PAUSE, LINE, PAIR = 0.5, 34, 25

_LEAD = frozenset(CONJUNCTIONS) | frozenset(PREPOSITIONS)
_HANG = frozenset(ARTICLES) | frozenset(PREPOSITIONS) | frozenset(AUXILIARIES)


def breaks(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words with ``good`` and ``bad``: whether a line may, or should not, end after this word."""
    order = Window.partitionBy(*keys).orderBy("pos")
    after = F.lead("w").over(order)
    token, follow = norm_token(F.col("w")), norm_token(after)
    upper = lambda c: (F.length(F.trim(c)) > 1) & F.substring(F.trim(c), 1, 1).rlike("^\\p{Lu}")
    good = F.col("w").rlike("[.,!?;:]$") | follow.isin(*_LEAD)
    bad = token.isin(*_HANG) | (upper(F.col("w")) & upper(after) & ~token.isin(*CONJUNCTIONS))
    return words.withColumns({"good": F.coalesce(good, F.lit(False)), "bad": F.coalesce(bad, F.lit(False))})


def islands(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words with ``island``: its number grows after every pause."""
    order = Window.partitionBy(*keys).orderBy("pos")
    fresh = (F.col("s") - F.lag("e").over(order) > PAUSE).cast("int")
    return words.withColumn("island", F.sum(F.coalesce(fresh, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def fold_lines(rows: list[tuple], rate: float) -> list[int]:
    """Line number of each word (w, s, e, good, bad) of one island.

    A word starts a new line when the line with it would be too long to read or to show. Where the line should not
    end before it, the words after the line's last good end move down with it.
    """
    out: list[int] = []
    number, first = 0, 0  # of the current line: its number and first word
    for i, (w, _, e, _, _) in enumerate(rows):
        if i > first:
            size = sum(len(r[0]) for r in rows[first : i + 1])
            room = rows[i - 1][2] - rows[first][1] + 0.5
            if size > LINE or (size / rate if rate > 0 else 999.0) > room:
                start = i
                if rows[i - 1][4]:
                    start = next((k + 1 for k in range(i - 2, first - 1, -1) if rows[k][3]), i)
                number += 1
                out[start:] = [number] * (i - start)
                first = start
        out.append(number)
    return out


def pack(words: DataFrame, keys: list[str], rate: float = 17.0) -> DataFrame:
    """Lines of words: keys, cue (ordered), words, chars, s, e, and whether it ends well (``good``) or is followed by a pause.

    Rows stream through Arrow batches sorted by island; only one island's words are held.
    """
    held = islands(breaks(words, keys), keys).select(*keys, "island", "pos", "w", "s", "e", "good", "bad")
    held = held.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "pos")
    schema = held.select(*keys, "island", "pos").schema.add("line", IntegerType())
    n = len(keys) + 1

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        now, island = None, []

        def give() -> list[tuple]:
            lines = fold_lines([r[n + 1 :] for r in island], rate)
            return [(*r[: n + 1], k) for r, k in zip(island, lines)]

        for batch in batches:
            done = []
            for row in batch.itertuples(index=False, name=None):
                if row[:n] != now:
                    if island:
                        done += give()
                    now, island = row[:n], []
                island.append(row)
            yield pd.DataFrame(done, columns=schema.names)
        if island:
            yield pd.DataFrame(give(), columns=schema.names)

    lines = held.mapInPandas(run, schema)
    full = held.join(lines, [*keys, "island", "pos"])
    return full.groupBy(*keys, "island", "line").agg(
        F.min("pos").alias("pos"), F.count("*").alias("words"), F.sum(F.length("w")).alias("chars"), F.min("s").alias("s"), F.max("e").alias("e"),
        F.max_by("good", "pos").alias("good"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("text"),
    )


def pairs(cues: DataFrame, keys: list[str], rate: float = 17.0) -> DataFrame:
    """Cues with ``event``: its first cue's pos. Two neighbours share an event if the first ends well, both are short and both can be read in their time.

    Greedy from the left: in a stretch of cues that could each pair with the next, the first goes with the second, the third with the fourth.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    nxt = lambda c: F.lead(c).over(order)
    both = F.col("chars") + nxt("chars")
    span = nxt("e") - F.col("s")
    can = F.col("good") & (nxt("s") - F.col("e") <= PAUSE) & (F.col("chars") <= PAIR) & (nxt("chars") <= PAIR) & (span > 0) & (both / rate <= span + 0.5)
    held = cues.withColumn("__can", F.coalesce(can, F.lit(False))).withColumn("__i", F.row_number().over(order))
    held = held.withColumn("__g", F.sum((~F.col("__can")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy(*keys, F.coalesce("__g", F.lit(0))).orderBy("pos"))
    held = held.withColumn("__odd", place % 2 == 1)
    event = F.when(F.col("__odd"), F.col("pos")).otherwise(F.lag("pos").over(order))
    return held.withColumn("event", event).drop("__can", "__i", "__g", "__odd")


def audit(events: DataFrame, warn: float = 18.0, fail: float = 20.0, least: float = 0.83) -> DataFrame:
    """Issue rows (severity, rule) of events with chars, s and e: too fast to read, or too short; one event can have two."""
    dur = F.col("e") - F.col("s")
    pace = F.when(dur > 0, F.col("chars") / dur).otherwise(F.lit(float("inf")))
    rules = F.array_compact(
        F.array(
            F.when(pace > fail, F.struct(F.lit("fail").alias("severity"), F.lit("pace").alias("rule"))).when(pace > warn, F.struct(F.lit("warn").alias("severity"), F.lit("pace").alias("rule"))),
            F.when(dur < least, F.struct(F.lit("warn").alias("severity"), F.lit("short").alias("rule"))),
        )
    )
    return events.withColumn("__i", F.explode(rules)).select(*events.columns, "__i.severity", "__i.rule")


def times(events: DataFrame, keys: list[str], pad: float = 0.15, least: float = 0.83, frame: float = 2 / 30) -> DataFrame:
    """Shown end of events: padded, long enough to read, two frames before the next; of equal starts (to a millisecond) the first stays."""
    order = Window.partitionBy(*keys).orderBy("s", "pos")
    end = F.least(F.greatest(F.col("e") + pad, F.col("s") + least), F.lead("s").over(order) - frame)
    held = events.withColumn("end", F.when(end <= F.col("s"), F.col("s") + 0.04).otherwise(end))
    held = held.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, F.round("s", 3)).orderBy("pos")))
    return held.filter("__n = 1").drop("__n")


#: Words that a hook has at most.
HOOK_WORDS = 4


def hook_errors(words: DataFrame, hooks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, anchor, error) of hooks that can't be placed: longer than HOOK_WORDS (in every clip), or an anchor that no word of the clip is."""
    asked = hooks.withColumn("token", norm_token(F.trim(F.coalesce("anchor", F.lit("")))))
    long = F.size(F.split(F.trim("text"), "\\s+")) > HOOK_WORDS
    held = [(r["text"], r["anchor"], r["token"], r["long"]) for r in _few(asked.select("text", "anchor", "token", F.coalesce(long, F.lit(False)).alias("long"))).collect()]
    rows = F.array(*[F.struct(F.lit(t).cast("string").alias("text"), F.lit(a).cast("string").alias("anchor"), F.lit(k).cast("string").alias("token"), F.lit(l).alias("long")) for t, a, k, l in held])
    if not held:
        return words.select(*keys, F.lit("").alias("text"), F.lit("").alias("anchor"), F.lit("").alias("error")).limit(0)
    # of each clip the anchors that it has, gathered before anything is shuffled; what is left of the list is lost
    token = norm_token(F.col("w"))
    have = words.groupBy(*keys).agg(F.collect_set(F.when(token.isin(*{k for _, _, k, _ in held}), token)).alias("__have"))
    lost = F.filter(rows, lambda h: h["long"] | ~F.array_contains(F.col("__have"), h["token"]))
    out = have.select(*keys, F.explode(lost).alias("__h"))
    return out.select(*keys, "__h.text", "__h.anchor", F.when(F.col("__h.long"), "too long").otherwise("no such word").alias("error"))


def _few(hooks: DataFrame, most: int = 1000) -> DataFrame:
    """Hooks of one edit; more than most fail."""
    if hooks.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} hooks")
    return hooks


def anchors(words: DataFrame, hooks: DataFrame, keys: list[str], dur: float = 0.9, strict: bool = False) -> DataFrame:
    """Hooks (text, anchor, dur) at the first word of each clip that is their anchor: start a tenth of a second after it, 0.8 to 2 seconds long.

    Hooks that a clip has no word for, or that are too long, are no rows here but rows of hook_errors(); strict raises for the first of them.
    """
    if strict and (wrong := hook_errors(words, hooks, keys).limit(1).collect()):
        raise ValueError(f"hook '{wrong[0]['text']}': {wrong[0]['error']}")
    if "text" in hooks.columns:
        hooks = hooks.filter(F.size(F.split(F.trim("text"), "\\s+")) <= HOOK_WORDS)
    asked = hooks.withColumn("token", norm_token(F.col("anchor")))
    # words that are no anchor go before anything is grouped
    said = words.withColumn("token", norm_token(F.col("w"))).join(asked.select("token").distinct(), "token", "left_semi")
    first = said.groupBy(*keys, "token").agg(F.min_by("e", "pos").alias("__e"), F.min("pos").alias("pos"))
    length = F.least(F.lit(2.0), F.greatest(F.lit(0.8), F.coalesce(F.nullif("dur", F.lit(0.0)), F.lit(dur))))
    met = first.join(asked, "token")
    return met.withColumns({"start": F.col("__e") + 0.1, "end": F.col("__e") + 0.1 + length}).drop("__e")


def busy(events: DataFrame, wide: int = 30) -> DataFrame:
    """Events that leave no room for a hook: two lines or a wide one."""
    return events.filter((F.col("lines") > 1) | (F.col("chars") > wide))


def dialogue(start: Column, end: Column, text: Column, style: str = "Karaoke") -> Column:
    """A line of a subtitle document."""
    from cadence.functions.scalars import timecode

    return F.concat(F.lit("Dialogue: 0,"), timecode(start), F.lit(","), timecode(end), F.lit(f",{style},,0,0,0,,"), F.replace(text, F.lit("\n"), F.lit("\\N")))
