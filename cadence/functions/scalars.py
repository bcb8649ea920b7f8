"""Column functions: tolerant parsing, keys, rates, formats, time codes, easing, notes. Built-in expressions only."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no number", and truth words.
NO_NUMBER = ["", "na", "n/a", "null", "-", "—", "none"]
TRUE = ["true", "yes", "si", "sí", "1", "on"]
FALSE = ["false", "no", "0", "off"]


def let(value: Column, then) -> Column:
    """An expression of a value that is worked out once, however often the expression has it."""
    return F.transform(F.array(value), lambda v: then(v))[0]


@lru_cache(maxsize=1)
def folding() -> tuple[str, str, dict[str, str]]:
    """What characters beyond ASCII leave in ASCII when Unicode takes them apart (NFKD): those that leave one character, what they leave, and
    those that leave several."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0x30000)):
        left = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if left:
            (one if len(left) == 1 else several)[c] = left
    return "".join(one), "".join(one.values()), several


def fold_ascii(text: Column) -> Column:
    """Text with accents, ligatures and other forms of ASCII letters folded, and what is left beyond ASCII dropped."""
    forms, plain, several = folding()
    places = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(places, c), c)), "")
    text = F.when(text.rlike(f"[{re.escape(''.join(several))}]"), spelt).otherwise(text)
    return F.regexp_replace(F.translate(text, forms, plain), "[^\\x00-\\x7F]", "")


def normalize_key(value: Column) -> Column:
    """A header or label as a key: lower case, accents folded, other characters one underscore, none at the ends."""
    text = F.coalesce(value, F.lit(""))
    # plain ASCII, as nearly all are, takes the short way
    text = F.lower(F.when(text.rlike("[^\\x00-\\x7F]"), fold_ascii(F.lower(F.trim(text)))).otherwise(F.trim(text)))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9_]+", "_"), "_+", "_"), F.lit("_"))


def slug(value: Column) -> Column:
    """Lower case, runs of other than letters and digits one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^\\p{L}\\p{N}]+", "-"), F.lit("-"))


def is_percent(value: Column) -> Column:
    return F.coalesce(F.trim(value).endswith("%"), F.lit(False))


def parse_number(value: Column) -> Column:
    """A number from text as people write it; null where there is none.

    One comma before exactly three digits groups thousands, any other comma is a decimal point unless there
    is a point too, in which case commas are dropped. What is no digit, sign, point or e is dropped.
    """
    def number(text: Column) -> Column:
        comma, point = text.contains(","), text.contains(".")
        even = (
            F.when(~comma, text).when(point | text.rlike("^-*[0-9]+,[^,]{3}$"), F.replace(text, F.lit(","), F.lit("")))
            .otherwise(F.replace(text, F.lit(","), F.lit(".")))
        )
        return let(F.regexp_replace(even, "[^0-9eE+.\\-]", ""), lambda d: F.when(d.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), d.try_cast("double")))

    def parsed(text: Column) -> Column:
        plain = text.rlike("^[0-9]+(\\.[0-9]+)?$")  # most are: no further look
        bare = F.regexp_replace(F.regexp_replace(text, "%$", ""), "[\\u00a0 ]", "")
        return F.when(plain, text.try_cast("double")).when(~F.lower(text).isin(NO_NUMBER), let(bare, number))

    return let(F.trim(value), parsed)


def parse_rate(value: Column) -> Column:
    """A share from a percentage or a fraction: written with % or above 1 it is divided by 100."""
    return let(parse_number(value), lambda n: F.when(is_percent(value) | (n > 1), n / 100).otherwise(n))


def parse_duration(value: Column) -> Column:
    """Seconds from h:m:s, m:s or a number."""
    parts = F.transform(F.split(F.trim(value), ":"), lambda p: F.trim(p).try_cast("double"))
    whole = value.contains(":") & ~F.exists(parts, lambda p: p.isNull())
    return (
        F.when(whole & (F.size(parts) == 3), parts[0] * 3600 + F.try_element_at(parts, F.lit(2)) * 60 + F.try_element_at(parts, F.lit(3)))
        .when(whole & (F.size(parts) == 2), parts[0] * 60 + F.try_element_at(parts, F.lit(2)))
        .otherwise(parse_number(value))
    )


def parse_bool(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(TRUE), True).when(text.isin(FALSE), False)


def as_bool(value: Column, default: Column | bool = False) -> Column:
    """True for truth words, false for anything else, the default for null."""
    return F.when(value.isNull(), default).otherwise(F.lower(F.trim(value.cast("string"))).isin(TRUE))


def platform(value: Column) -> Column:
    """One name for each known platform, else the trimmed lower-case text; blank is null."""
    key = normalize_key(value)
    other = F.lower(F.trim(value))
    return (
        F.when(key.contains("tiktok") | (key == "douyin"), "tiktok")
        .when(key.contains("instagram") | key.contains("reels"), "instagram_reels")
        .when(key.contains("youtube") | key.contains("shorts"), "youtube_shorts")
        .when(other != "", other)
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where a side is null or the denominator zero."""
    return F.try_divide(numerator.cast("double"), denominator)


def first_nonzero(*values: Column) -> Column:
    """The first value that is neither null nor zero; the last as it is."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])


def finite(value: Column) -> Column:
    """The value, null if it is not a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def mean_of(*values: Column) -> Column:
    """Mean of the finite values of a row; null if there are none."""
    held = F.filter(F.array(*[finite(v) for v in values]), lambda v: v.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.size(held))


def format_pct(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f%%", value * 100))


def format_num(value: Column) -> Column:
    size = F.abs(value)
    return F.when(value.isNull(), "n/a").when(size >= 1000, F.format_number(value, 0)).when(size >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.3f", value))


def norm_token(word: Column) -> Column:
    """A word for comparison: trimmed, lower case, without end punctuation."""
    return F.regexp_replace(F.lower(F.trim(word)), "[.,!?;:]+$", "")


def locale_text(text: Column, variant: str | None) -> Column:
    """Decimal sign and clock of a Spanish variant: es-ES or es-LATAM; None leaves the text."""
    if variant is None:
        return text
    if variant == "es-ES":
        return F.regexp_replace(text, "([0-9])\\.([0-9])", "$1,$2")
    if variant != "es-LATAM":
        raise ValueError(f"unknown variant {variant}")
    text = F.regexp_replace(text, "([0-9]),([0-9])", "$1.$2")
    hours = F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![0-9])([0-9]{1,2}):[0-9]{2}(?![:0-9])"), F.lit(1)))

    def rewrite(t: Column, written: Column) -> Column:
        h = written.cast("int")
        shown = F.when(h == 0, 12).when(h <= 12, h).otherwise(h - 12).cast("string")
        # marks keep what is rewritten from being read again
        new = F.concat(F.lit("\u0001"), shown, F.lit("\u0002$1"), F.when(h < 12, " a. m.").otherwise(" p. m."))
        return F.regexp_replace(t, F.concat(F.lit("(?<![0-9])"), written, F.lit(":([0-9]{2})(?![:0-9])")), new)

    text = F.aggregate(hours, text, rewrite)
    return F.replace(F.replace(text, F.lit("\u0001"), F.lit("")), F.lit("\u0002"), F.lit(":"))


def timecode(seconds: Column) -> Column:
    """H:MM:SS.cc; below zero is zero, hundredths never carry."""
    t = F.greatest(seconds, F.lit(0.0))
    hundredths = F.least(F.rint((F.pmod(t, F.lit(60.0)) - F.floor(F.pmod(t, F.lit(60.0)))) * 100), F.lit(99))
    return F.format_string("%d:%02d:%02d.%02d", F.floor(t / 3600), F.floor(F.pmod(t, F.lit(3600.0)) / 60), F.floor(F.pmod(t, F.lit(60.0))), hundredths.cast("long"))


def quantize(t: Column, fps: float) -> Column:
    """The nearest frame's time, half to even."""
    return F.rint(t * fps) / fps


def ease(p: Column, curve: Column | float = 50.0, easing: str = "smooth") -> Column:
    """Eased progress in 0..1; curve 0..100 sharpens it."""
    p = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    c = F.least(F.greatest(F.lit(curve) if isinstance(curve, (int, float)) else curve, F.lit(0.0)), F.lit(100.0))
    if easing == "linear":
        return p
    if easing == "in":
        return F.pow(p, 1 + c / 50)
    if easing == "out":
        return 1 - F.pow(1 - p, 1 + c / 50)
    if easing != "smooth":
        raise ValueError(f"unknown easing {easing}")
    a = 1 + c / 25
    return F.pow(p, a) / (F.pow(p, a) + F.pow(1 - p, a))


def atempo_chain(factor: Column) -> Column:
    """Equal tempo factors, each of 0.5 or more, whose product is the factor; none for 1."""
    n = F.ceil(F.round(F.log(factor) / F.log(F.lit(0.5)), 12)).cast("int")
    return F.when(factor == 1, F.array().cast("array<double>")).when(factor >= 0.5, F.array(factor)).otherwise(F.array_repeat(F.pow(factor, 1.0 / n), n))


def midi_to_freq(midi: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi - 69) / 12.0)


#: Note names from C.
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def midi_to_name(midi: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NOTES])
    return F.concat(F.element_at(names, F.pmod(midi, F.lit(12)).cast("int") + 1), (F.floor(midi / 12) - 1).cast("string"))


def fill(text: Column, values: Column) -> Column:
    """Every <name> in the text replaced by the map's value of that name; a name without a value fails."""
    full = F.aggregate(F.map_entries(values), text, lambda t, e: F.replace(t, F.concat(F.lit("<"), e["key"], F.lit(">")), e["value"]))
    return F.when(full.rlike("<[A-Za-z_][A-Za-z0-9_]*>"), F.raise_error(F.concat(F.lit("no value for a name in: "), text))).otherwise(full)


#: Steps of scales from their root.
SCALES = {"major": [0, 2, 4, 5, 7, 9, 11], "minor": [0, 2, 3, 5, 7, 8, 10]}


def note_to_midi(name: Column, octave: Column) -> Column:
    """Number of a note from its name (sharps) and octave; an unknown name is null."""
    place = F.array_position(F.array(*[F.lit(n) for n in NOTES]), F.upper(F.trim(name)))
    return F.when(place > 0, (octave + 1) * 12 + place - 1).cast("int")


def scale(root: Column, mode: str, octaves: int = 1) -> Column:
    """Notes of a scale over octaves, the root above them last."""
    steps = [12 * o + s for o in range(octaves) for s in SCALES[mode]] + [12 * octaves]
    return F.transform(F.array(*[F.lit(s) for s in steps]), lambda s: s + root)


def triad(root: Column, mode: str) -> Column:
    steps = SCALES[mode]
    return F.transform(F.array(*[F.lit(steps[k]) for k in (0, 2, 4)]), lambda s: s + root)


def voice_leading(a: Column, b: Column) -> Column:
    """The inversion and octave of chord b nearest to chord a: least total movement, then least single step."""
    def moved(turn: int, octave: int) -> Column:
        notes = [F.element_at(b, (k + turn) % 3 + 1) + 12 * octave + (12 if k + turn >= 3 else 0) for k in range(3)]
        steps = [F.abs(n - F.element_at(a, k + 1)) for k, n in enumerate(notes)]
        return F.struct((steps[0] + steps[1] + steps[2]).alias("total"), F.greatest(*steps).alias("most"), F.array(*notes).alias("notes"))

    return F.array_min(F.array(*[moved(t, o) for t in range(3) for o in (-1, 0, 1)]))["notes"]
