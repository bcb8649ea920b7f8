"""Frames with known breaths, clicks, plosives and decays; option rules."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cadence.operators import voice
from cadence.plans import options


def frames(spark, levels, **bands):
    rows = [(1, i, float(x), *(float(b[i]) for b in bands.values())) for i, x in enumerate(levels)]
    return spark.createDataFrame(rows, "k int, frame long, level_db double" + "".join(f", {n} double" for n in bands))


def test_breaths(spark):
    levels = [-10] * 40 + [-40] * 20 + [-10] * 40 + [-70] * 20 + [-10] * 10 + [-40] * 5 + [-10] * 10 + [-40] * 200
    hi = [-30.0] * len(levels)
    lo = [-50.0] * len(levels)
    got = voice.breaths(frames(spark, levels, high_db=hi, low_db=lo), ["k"]).collect()
    assert [(r["first"], r["last"]) for r in got] == [(40, 59)]  # the others are silent, short or long
    assert voice.breaths(frames(spark, levels, high_db=lo, low_db=hi), ["k"]).count() == 0


def test_clicks_and_plosives(spark):
    levels = [-60] * 400
    levels[100:105] = [-20] * 5
    levels[200:240] = [-20] * 40
    got = voice.clicks(frames(spark, levels, band_db=levels), ["k"]).collect()
    assert [(r["first"], r["last"]) for r in got] == [(100, 104)]
    on = [False] * 10 + [True] * 40 + [False] * 10 + [True] * 40
    rows = [(1, i, f, -20.0 if 10 <= i < 15 else -60.0, -40.0) for i, f in enumerate(on)]
    df = spark.createDataFrame(rows, "k int, frame long, active boolean, sub_db double, mid_db double")
    assert [r["first"] for r in voice.plosives(df, ["k"]).collect()] == [10]


def test_plosives_on_the_bound_are_those_of_the_sql(spark):
    """Two frames whose levels differ by 6 dB as one: the last place of powers and logarithms decides."""
    ties = [((a, b), (a - 6, b - 6)) for a in range(-20, -3) for b in range(-20, a)] + [((a, b), (b - 6, a - 6)) for a in range(-20, -3) for b in range(-20, a)]
    rows = [(n, i, True, float(s[i]), float(m[i])) for n, (s, m) in enumerate(ties) for i in (0, 1)]
    df = spark.createDataFrame([*rows, (-1, 0, True, None, None), (-2, 0, True, -10.0, None)], "k int, frame long, active boolean, sub_db double, mid_db double")
    con = duckdb.connect()
    con.execute("create table t (k int, i int, a boolean, s double, m double)")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", rows)
    want = con.execute("select k from (select * from t order by k, i) group by k having 10 * log10(sum(pow(10, s / 10))) - 10 * log10(sum(pow(10, m / 10))) > 6").fetchall()
    assert 0 < len(want) < len(ties)
    assert sorted(r["k"] for r in voice.plosives(df, ["k"]).collect()) == sorted(k for k, in want)


def test_decay_and_report(spark):
    rows = [(1, i, -15.0 + random.Random(i).random(), True) for i in range(60)] + [(1, 60 + i, -15.0 - 1.2 * i, False) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, frame long, level_db double, active boolean")
    r = voice.rt60(voice.tails(df, ["k"]), ["k"]).first()
    assert abs(r["rt60_s"] - 0.5) < 0.02 and r["reverb"] == "medium" and r["confidence"] > 0.5
    out = voice.report(df, ["k"]).first()
    assert out["frames"] == 100 and out["speech_ratio"] == 0.6 and out["verdict"] in ("good", "fair", "poor") and out["snr_db"] > 0
    assert voice.gate(df, ["k"]).count() == 1 and voice.gate(df.withColumn("active", F.lit(False)), ["k"]).count() == 0
    with pytest.raises(Exception, match="no speech"):
        voice.gate(df.withColumn("active", F.lit(False)), ["k"], strict=True).collect()


def test_option_rules(spark):
    rows = [
        (1, "zoom", {"pct": "40"}, []), (2, "zoom", {"pct": "0"}, ["zoom.pct"]), (3, "zoom", {"pct": "150", "direction": "shrink"}, ["shrink to nothing"]), (4, "zoom", {"start": "3", "end": "2"}, ["end not after start"]),
        (5, "lowpass", {"order": "1", "resonance": "1"}, ["resonance of a first-order filter"]), (6, "lowpass", {"cutoff": "x"}, ["lowpass.cutoff"]), (7, "warp", {}, ["effect"]), (8, "riser", {"hit": "1", "dur": "2"}, ["hit before it can rise"]), (9, "melody", {"bars": "64", "bpm": "301"}, ["melody.bpm"]),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, effect string, options map<string,string>")
    assert {r["id"]: r["errors"] for r in options.violations(df).collect()} == {r[0]: r[3] for r in rows}
    s = spark.range(1).select(options.segment(F.lit(-1.0), F.lit(9.0), F.lit(5.0)).alias("s"), options.placement_errors(F.lit(5.0), F.lit(6.0), F.lit(5.0)).alias("e"), options.quality(F.lit(5.0), F.lit(5.2), F.lit(30.0), F.lit(25.0), F.lit(5.1)).alias("q"), options.estimate_seconds(F.lit(85), F.lit("anime"), F.lit(720)).alias("t")).first()
    assert tuple(s["s"]) == (0.0, 5.0, True) and s["e"] == ["starts after the clip", "ends after the clip"] and s["q"] == ["frame rate drifts", "too long"] and abs(s["t"] - 100) < 1e-9


def test_waypoints(spark):
    cells = spark.createDataFrame([(1, c) for c in range(4)], "k int, cell int")
    assert [r["at"] for r in options.waypoints(cells, None, ["k"], 2.5, 1.5).orderBy("cell").collect()] == [0.0, 4.0, 8.0, 12.0]
    moments = spark.createDataFrame([(1, 7.0), (1, 2.0)], "k int, at double")
    assert sorted((r["cell"], r["at"]) for r in options.waypoints(cells, moments, ["k"], 1, 1).collect()) == [(0, 2.0), (1, 7.0)]
