"""Literal rows for every trap of the parsers and formats."""

import pytest
from pyspark.sql import functions as F

from cadence.functions import scalars as S


def one(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", column(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_numbers(spark):
    cases = {"12,345": 12345.0, "3,5": 3.5, "1,234,567": None, "1.234,56": 1.23456, "1.2K": 1.2, "1 view": None, "n/a": None, "70%": 70.0, "": None, "—": None, " 42 ": 42.0, "1e": None, "-2,500": -2500.0, "1e5": 1e5, ".5": 0.5, "5.": 5.0, " 1 000": 1000.0}
    assert one(spark, list(cases), S.parse_number) == list(cases.values())
    assert one(spark, [None], S.parse_number) == [None]


def test_rates(spark):
    cases = {"1": 1.0, "1.2": 0.012, "120%": 1.2, "0.5%": 0.005, "42": 0.42, "0.3": 0.3, "x": None}
    got = one(spark, list(cases), S.parse_rate)
    assert all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-12) for g, w in zip(got, cases.values()))


def test_durations_and_truth(spark):
    assert one(spark, ["1:02:03", "1:30", "12", "a:b", "1:2:3:4"], S.parse_duration) == [3723.0, 90.0, 12.0, None, 1234.0]
    assert one(spark, ["yes", "SÍ", "off", "x", None], S.parse_bool) == [True, True, False, None, None]
    assert one(spark, ["yes", "x", None], lambda c: S.as_bool(c, True)) == [True, False, True]


def test_keys(spark):
    assert one(spark, ["25%", " Émission / Día ", "a--b__c", None, "__x__"], S.normalize_key) == ["25", "emission_dia", "a_b_c", "", "x"]
    assert one(spark, ["Tik Tok", "TikTok", "douyin", "IG reels", "Shorts!", " Other ", " "], S.platform) == ["tik tok", "tiktok", "tiktok", "instagram_reels", "youtube_shorts", "other", None]
    assert one(spark, ["A b/C..d", "--", "Ünï 9"], S.slug) == ["a-b-c-d", "", "ünï-9"]


def test_division_and_fallthrough(spark):
    row = spark.range(1).select(S.ratio(F.lit(1.0), F.lit(0.0)).alias("a"), S.ratio(F.lit(None).cast("double"), F.lit(1.0)).alias("b"), S.first_nonzero(F.lit(0.0), F.lit(10.0), F.lit(3.0)).alias("c"), S.mean_of(F.lit(1.0), F.lit(float("nan")), F.lit(None).cast("double"), F.lit(2.0)).alias("d"), S.mean_of(F.lit(None).cast("double")).alias("e")).first()
    assert tuple(row) == (None, None, 10.0, 1.5, None)


def test_formats(spark):
    assert one(spark, [1234.5, 12.345, 0.12345, None], S.format_num, "double") == ["1,234", "12.3", "0.123", "n/a"]
    assert one(spark, [3661.999, -5.0, 59.999, 0.0], S.timecode, "double") == ["1:01:01.99", "0:00:00.00", "0:00:59.99", "0:00:00.00"]
    assert one(spark, [0.5, 1.5, 2.5], lambda c: S.quantize(c, 1.0), "double") == [0.0, 2.0, 2.0]


def test_locale(spark):
    assert one(spark, ["a 3.5 b", "v1.2.3"], lambda c: S.locale_text(c, "es-ES")) == ["a 3,5 b", "v1,2.3"]
    cases = {"son 3,5": "son 3.5", "0:05": "12:05 a. m.", "09:30 y 12:00": "9:30 a. m. y 12:00 p. m.", "23:59": "11:59 p. m.", "1:02:03": "1:2:03 a. m.", "25:00": "13:00 p. m.", "12:345": "12:345"}
    assert one(spark, list(cases), lambda c: S.locale_text(c, "es-LATAM")) == list(cases.values())
    with pytest.raises(ValueError):
        S.locale_text(F.lit("x"), "es-XX")


def test_easing(spark):
    for kind in ("linear", "in", "out", "smooth"):
        got = one(spark, [-1.0, 0.0, 0.5, 1.0, 2.0, None], lambda c, k=kind: S.ease(c, 50.0, k), "double")
        assert got[0] == got[1] == 0.0 and got[3] == got[4] == 1.0 and got[5] is None and 0 < got[2] < 1


def test_tempo_and_notes(spark):
    got = one(spark, [1.0, 0.75, 0.5, 0.25, 0.2], S.atempo_chain, "double")
    assert [len(g) for g in got] == [0, 1, 1, 2, 3] and all(abs(__import__("math").prod(g) - f) < 1e-9 for g, f in zip(got[1:], [0.75, 0.5, 0.25, 0.2]))
    assert one(spark, [60, 69, 21], S.midi_to_name, "int") == ["C4", "A4", "A0"] and one(spark, [69], S.midi_to_freq, "int") == [440.0]


def test_placeholders(spark):
    df = spark.createDataFrame([("a <x> and <y>, <x>", {"x": "1", "y": "<"})], "t string, m map<string,string>")
    assert df.select(S.fill(F.col("t"), F.col("m")).alias("r")).first()["r"] == "a 1 and <, 1"
    with pytest.raises(Exception, match="no value"):
        df.select(S.fill(F.lit("<z>"), F.col("m")).alias("r")).collect()
