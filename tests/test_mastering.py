"""Mastering, repairs and tonal elements against what they promise, and the commands over recordings."""

import io
import json
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence import cli
from cadence.operators import frames as R
from cadence.operators import mastering as M
from cadence.operators import signal as K
from cadence.operators import tones as T
from cadence.sources import records, sinks
from cadence.streaming import events as E

RATE = M.RATE


def tone(f: float, seconds: float = 1.0, size: float = 0.3) -> np.ndarray:
    return size * np.sin(2 * np.pi * f * np.arange(int(RATE * seconds)) / RATE)


def db(x: np.ndarray) -> float:
    return 20 * np.log10(np.sqrt((x**2).mean()) + 1e-12)


def test_equaliser_is_bounded():
    assert abs(db(M.vocal_eq(tone(180), mud=-9.0)[9600:]) - db(tone(180)[9600:]) + 4) < 0.2
    assert np.allclose(M.vocal_eq(tone(440)), tone(440))


def test_deesser_turns_down_what_is_sharp_only():
    sharp, dull = tone(6000, size=0.3), tone(400, size=0.3)
    assert -6.5 < db(M.deess(sharp)[9600:]) - db(sharp[9600:]) < -5 and abs(db(M.deess(dull)) - db(dull)) < 0.01
    assert np.array_equal(M.deess(sharp[:100]), sharp[:100])


def test_compressor_and_limiter():
    loud, quiet = tone(500, size=0.9), tone(500, size=0.01)
    assert db(M.compress(loud)[9600:]) < db(loud[9600:]) - 5 and abs(db(M.compress(quiet)) - db(quiet)) < 0.1
    spike = np.zeros(RATE)
    spike[24_000] = 2.0
    out = M.limit(spike + tone(200, size=0.1))
    assert np.abs(out).max() <= 10 ** (-1 / 20) + 1e-9 and np.allclose(out[:20_000], tone(200, size=0.1)[:20_000])
    assert M.limit(out) is out or np.allclose(M.limit(out), out)


def test_true_peak_and_loudness():
    between = tone(RATE / 4, size=1.0)
    shifted = np.sin(2 * np.pi * (RATE / 4) * np.arange(RATE) / RATE + np.pi / 4)
    assert np.abs(shifted).max() < 0.72 and abs(M.true_peak(shifted)) < 0.3 and abs(M.true_peak(between)) < 0.3
    x = tone(997, 4.0, 0.05)
    for target in (-23.0, -16.0):
        assert abs(K.loudness(M.to_loudness(x, RATE, target)) - target) < 0.1
    noisy = np.random.default_rng(0).standard_normal(4 * RATE) * 0.02
    noisy[::4800] = 0.9
    assert M.true_peak(M.to_loudness(noisy, RATE, -9.0)) <= -0.99
    assert np.array_equal(M.to_loudness(np.zeros(RATE)), np.zeros(RATE))
    steps = np.concatenate([tone(997, 5, 0.02), tone(997, 5, 0.2)])
    assert M.loudness_range(tone(997, 8)) < 0.2 and 15 < M.loudness_range(steps) < 21 and M.loudness_range(tone(997, 1)) is None


def test_resampling_and_admission(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    y = M.resample(x, 16_000)
    assert len(y) == RATE and np.abs(y[4800:-4800] - np.sin(2 * np.pi * 440 * np.arange(RATE) / RATE)[4800:-4800]).max() < 1e-3
    clips = spark.createDataFrame([(1, 16_000, [float(v) for v in x[:1600]]), (2, 48_000, [0.5])], "id int, rate int, samples array<float>")
    got = {r["id"]: (r["rate"], len(r["samples"])) for r in M.admit(clips).collect()}
    assert got == {1: (48_000, 4800), 2: (48_000, 1)}
    with pytest.raises(Exception, match="rate not admitted: 8000"):
        M.admit(clips.selectExpr("id", "8000 as rate", "samples")).collect()


def test_chain_and_presets(spark):
    x = tone(300, 2.0, 0.2) + 0.01
    y, ran = M.process(x, "podcast")
    assert ran == ["dc_block", "highpass", "eq", "deesser", "compressor", "limiter", "loudness"] and abs(K.loudness(y) + 16) < 0.3 and abs(y.mean()) < 1e-3
    assert M.process(x, "creator", dehum=50, no_eq=True, no_comp=True, no_limit=True, no_loudnorm=True)[1] == ["dc_block", "highpass", "dehum"]
    clips = spark.createDataFrame([(1, [float(v) for v in x[:24_000]])], "id int, samples array<float>")
    row = M.master(clips, "social").first()
    assert row["id"] == 1 and row["stages"][-1] == "loudness" and len(row["samples"]) == 24_000
    with pytest.raises(ValueError, match="unknown preset"):
        M.master(clips, "loudest")


def test_repairs(spark):
    x = tone(60, 1.0, 0.4) + tone(1000, 1.0, 0.1)
    y = M.deplosive(x, [(9600, 28_800)])
    assert np.array_equal(y[:9600], x[:9600]) and np.array_equal(y[28_800:], x[28_800:]) and db(y[14_400:24_000]) < db(x[14_400:24_000]) - 3
    cut = M.remove_regions(x, [(30_000, 40_000), (10_000, 20_000)], 96)
    assert len(cut) == RATE - 20_000 and np.allclose(cut[200:9_800], x[200:9_800]) and np.allclose(cut[10_200:19_800], x[20_200:29_800])
    with pytest.raises(ValueError, match="nothing to mend"):
        M.mend_one(x)
    clips = spark.createDataFrame([(1, [float(v) for v in x[:4800]], [[100, 900]]), (2, [0.1] * 4800, None)], "id int, samples array<float>, p array<array<int>>")
    assert M.mend(clips, declip=True, plosives="p").count() == 2
    assert len(M.quieten(x, [(100, 4900)], [(9000, 9500)], remove=True)) == RATE - 4800


def test_speech_frames(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal(14_400) * 1e-4, tone(300, 0.3), rng.standard_normal(14_400) * 1e-4])
    got = M.speech_frames(spark.createDataFrame([(1, [float(v) for v in x])], "id int, samples array<float>"), ["id"]).orderBy("frame").collect()
    assert [r["active"] for r in got] == [False] * 10 + [True] * 10 + [False] * 10


def test_gains_between_frames(spark):
    f = spark.createDataFrame([(k, g) for k, g in enumerate([1.0, 0.5, 0.8])], "frame int, gain double").selectExpr("'a' as key", "*")
    got = [r["gain"] for r in M.spread_gains(f, ["key"], "frame", "gain", 8).orderBy("sample").collect()]
    assert np.allclose(got, M.spread(np.array([1.0, 0.5, 0.8]), 8, 24))


def test_attack_is_for_falls(spark):
    rows = [(1, k, v) for k, v in enumerate([0.2, 0.2, 1.0])]
    got = [r["smooth"] for r in E.smooth_levels(spark.createDataFrame(rows, "k int, at int, v double"), "k", "at", "v", 0.5, 0.1).orderBy("at").collect()]
    assert np.allclose(got, [0.6, 0.4, 0.46]) and np.allclose(M.follow(np.array([0.2, 0.2, 1.0]), 0.5, 0.1), got)


def test_moving_average_is_centred(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    for taps in (5, 6):
        rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "key string, at int, v double")
        got = [r["smooth"] for r in R.moving_average(rows, ["key"], "at", "v", taps).orderBy("at").collect()]
        assert np.allclose(got, np.convolve(values, np.ones(taps) / taps, "same"))


def test_tones():
    for name, mood in T.MOODS.items():
        x = T.render(T.strands(mood, 0.0, 0.2, 69), 0.2, 8000)
        assert len(x) == 1600 and np.abs(x).max() <= 1.8 and abs(x[-1]) < 0.1, name
        notes = T.melody_notes(name, 2, seed=3)
        assert notes == T.melody_notes(name, 2, seed=3) and notes != T.melody_notes(name, 2, seed=4)
        ends = [n["t_on"] + n["dur"] for n in notes]
        assert np.allclose(ends[:-1], [n["t_on"] for n in notes[1:]]) and abs(ends[-1] - 2 * 240 / mood.bpm) < 1e-9
        assert notes[0]["midi"] == mood.tonic and (notes[-1]["midi"] - mood.tonic) % 12 == 0 and all((n["midi"] - mood.tonic) % 12 in T.MODES[mood.mode] for n in notes)
    x = T.riser("hope", 1.0, 0.2, rate=8000)
    assert len(x) == 9600 and abs(np.abs(x).max() - 0.5) < 1e-9 and db(x[:2000]) < db(x[6000:8000]) - 10
    assert len(T.riser("calm", 1.0, 0.0, "glide", 8000)) == 8000 and len(T.transition("calm", "hope", 0.5, 8000)) == 4000
    with pytest.raises(ValueError, match="unknown mood"):
        T.riser("bored", 1.0)


def test_curves_go_through_their_points():
    t = np.linspace(-1, 4, 501)
    y = T.traced([(0, 0), (1, 1), (2, 1), (3, 0.5)], t)
    assert np.allclose(np.interp([-1, 0, 0.5, 1, 1.5, 2, 2.5, 3, 4], t, y), [0, 0, 0.5, 1, 1, 1, 0.75, 0.5, 0.5], atol=1e-9)


def test_notes_in_blocks_are_the_piece(spark):
    rows = [{"id": 1} | r for r in T.riser_notes(T.MOODS["calm"], 1.0, 0.3)] + [{"id": 2} | r for r in T.transition_rows("calm", "hope", 0.7)]
    df = spark.createDataFrame([tuple(r[c] for c in ["id", *T.COLUMNS]) for r in rows], "id long, " + T.NOTE).repartition(3)
    got = {}
    for r in sorted(T.rendered(df, ["id"], 0.25, 8000).collect(), key=lambda r: (r.id, r.block)):
        got.setdefault(r.id, []).extend(r.samples)
    for k, seconds in ((1, 1.3), (2, 0.7)):
        want = T.render([r for r in rows if r["id"] == k], seconds, 8000)
        assert np.allclose(got[k][: len(want)], want, atol=1e-6)


def test_riser_notes_as_columns(spark):
    asked = spark.createDataFrame([("hope", 2.0, 0.5), ("urgency", 1.0, 0.0)], "mood string, hit double, tail double")
    for r in asked.select("*", T.riser_rows(F.col("mood"), F.col("hit"), F.col("tail")).alias("n")).collect():
        own = T.riser_notes(T.MOODS[r.mood], r.hit, r.tail)[::2]
        assert len(own) == len(r.n)
        assert np.allclose([(n.t_on, n.dur, n.midi, n["size"]) for n in r.n], [(o["start"], o["length"], o["midi"] - T.MOODS[r.mood].detune_cents / 100, 2 * o["size"]) for o in own])
        assert abs(max(n.t_on + n.dur for n in r.n) - r.hit - r.tail) < 0.1 * r.hit


def test_resolved_options(spark):
    o = spark.createDataFrame([("hope", None, 0.5, None, None, None, 10.0), ("calm", 4.0, None, 99.0, 1.0, 3.0, 10.0)], "mood string, hit double, tail double, bpm double, start double, end double, duration_s double")
    assert [(r["hit"], r["bpm"], r["segment_s"]) for r in T.resolved(o).collect()] == [(9.5, 90.0, 10.0), (4.0, 99.0, 2.0)]
    asked = spark.createDataFrame([(1, "hope", 2, None, 5), (2, "calm", 1, 80.0, 5)], "id int, mood string, bars int, bpm double, seed int")
    got = T.melodies(spark, asked).collect()
    assert [r["midi"] for r in got if r["id"] == 1] == [n["midi"] for n in T.melody_notes("hope", 2, None, 5)] and {r["id"] for r in got} == {1, 2}


def test_provenance(spark):
    text = spark.range(1).select(M.provenance(seed=None, preset="social", seconds=1.5)).first()[0]
    assert json.loads(text) == {"cadence_version": "2", "device": "cpu", "sample_rate": 48_000, "preset": "social", "seconds": 1.5}


def test_commands_over_recordings(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    wav, out = str(tmp_path / "a.wav"), str(tmp_path / "b.wav")
    rng = np.random.default_rng(2)
    x = np.concatenate([tone(300, 1.0, 0.2), rng.standard_normal(2 * RATE) * 1e-4, tone(300, 1.0, 0.2)])
    sinks.write_wav(x, RATE, wav)
    for command in ("inspect", "analyze", "score"):
        assert cli.main([command, "--input", wav, "--format", "terminal"]) == 0
    assert "seconds" in capsys.readouterr().out
    assert cli.main(["master", "--input", wav, "--preset", "podcast", "--output", out]) == 0 and cli.main(["master", "--input", wav, "--dry-run"]) == 0
    assert cli.main(["silence", "--input", wav, "--output", out]) == 0
    assert abs(cli.clips(spark, out).selectExpr("size(samples) n").first()["n"] - (len(x) - 1.5 * RATE)) < 0.1 * RATE
    assert cli.main(["restore", "--input", wav, "--output", out]) == 2 and cli.main(["restore", "--input", wav, "--declip", "--output", out]) == 0
    assert cli.main(["melody", "--mood", "urgency", "--bars", "1", "--output", out]) == 0 and cli.main(["riser", "--dur", "0.5", "--output", out]) == 0
    assert cli.main(["transition", "--dur", "0.3", "--output", out]) == 0


def test_records_from_standard_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    for text in ('[{"id": "a", "views": 3, "date": "2024-02-01"}, {"id": "b", "views": 5, "date": "2024-01-01"}]', "id,views,date\na,3,2024-02-01\nb,5,2024-01-01\n"):
        monkeypatch.setattr(sys, "stdin", io.StringIO(text))
        assert cli.main(["metrics", "--input", "-", "--output", str(tmp_path / "r.json")]) == 0
        report = json.loads((tmp_path / "r.json").read_text())
        assert report["input"] == [{"date_max": "2024-02-01", "date_min": "2024-01-01", "platforms": ["unknown"], "rows": 2}]
        assert report["questions"][0]["question"] == "fields" and report["outcome"][0]["confidence"] == "preliminary"
    (tmp_path / "odd.txt").write_text('  {"videos": [{"id": "a", "views": 1}]}')
    assert records.read(spark, str(tmp_path / "odd.txt")).count() == 1
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert records.read_json_lines(spark, str(tmp_path / "l.jsonl")).count() == 2


def test_execution_manifest():
    got = json.loads(sinks.manifest_json("edit", {"crf": 18}, ["b", "a"], [{"stage": "cut", "ok": True}], ["x"]))
    assert got["inputs"] == ["a", "b"] and got["ok"] and len(got["config_sha256"]) == 16


def test_clips_are_spread_over_tasks_and_the_chain_runs_once(spark):
    """Rows that make clips are small, so adaptive execution would join them to one task."""
    from cadence.queries import timeline

    made = timeline.clips(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = timeline.mastered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 3  # bursts, chain, measures


def _loop(values, rise, fall, first):
    """Sample by sample, as it is defined."""
    out, state = np.empty(len(values)), first
    for i, v in enumerate(values.tolist()):
        state += (rise if v > state else fall) * (v - state)
        out[i] = state
    return out


def test_signals_followed_side_by_side_are_followed_one_by_one():
    rng = np.random.default_rng(4)
    t = np.arange(50_001) / RATE
    signals = [np.abs(np.sin(2 * np.pi * 3000 * t)) * (t < 0.7), rng.random(777), np.full(9000, 0.3), np.empty(0), np.zeros(5000), rng.normal(0, 1, 20_000) * (rng.random(20_000) < 0.01)]
    for rise, fall, first in ((0.002, 0.0001, 0.0), (0.0004, 1.0, 1.0), (0.03, 0.4, 1.0), (0.5, 0.0, 0.2), (0.1, 0.1, 0.0)):
        for x, got in zip(signals, K.followed(signals, rise, fall, first)):
            assert len(got) == len(x) and np.allclose(got, _loop(x, rise, fall, first), rtol=1e-11, atol=1e-14)
    holed = np.where(np.arange(3000) == 1500, np.nan, 0.1)
    got = K.followed([holed, signals[1]], 0.002, 0.0001, 0.0)
    assert not np.isnan(got[0][:1500]).any() and np.isnan(got[0][1500:]).all() and np.allclose(got[1], _loop(signals[1], 0.002, 0.0001, 0.0))


def test_a_clips_level_takes_no_step_of_python_a_sample():
    x = 0.3 * np.sin(np.arange(10 * RATE) / 7)

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    rise, fall = 1 - np.exp(-1 / (0.010 * RATE)), 1 - np.exp(-1 / (0.150 * RATE))
    assert min(seconds(lambda: M.compress(x)) for _ in range(3)) < 0.5 * min(seconds(lambda: _loop(np.abs(x), rise, fall, 0.0)) for _ in range(3))


def test_limiter_and_true_peak_are_their_definitions():
    rng = np.random.default_rng(6)
    t = np.arange(9001) / RATE
    for x in (rng.normal(0, 0.8, 9001), 1.5 * np.sin(2 * np.pi * 400 * t) * (t > 0.1), np.where(rng.random(800) < 0.01, -1.0, 0.01), np.ones(3), np.tile([0.5, -0.5], 64)):
        top, n = 10 ** (-1 / 20), 240
        need = np.minimum(1.0, top / np.maximum(np.abs(x), 1e-12))
        least = np.array([need[i : i + n + 1].min() for i in range(len(x))])
        want = x * np.minimum(_loop(least, 1 - np.exp(-1 / (0.050 * RATE)), 1.0, 1.0), need)
        assert np.allclose(M.limit(x), want, rtol=1e-11, atol=1e-14)
        for part in (x, x[:-1]):
            peak = 20 * np.log10(np.abs(M.resample(part, 1, 4)).max() + 1e-12)
            assert abs(M.true_peak(part) - peak) < 1e-9
            assert M.true_peak(part, above=60.0) > peak - 1e-9 and abs(M.true_peak(part, above=-60.0) - peak) < 1e-9
    assert M.true_peak(np.empty(0)) == float("-inf")


def test_filters_are_the_recursion_of_any_length():
    b, a = K.highpass(80.0, RATE)
    rng = np.random.default_rng(8)
    for n in (0, 1, 63, 64, 65, 64 * 33 + 5):
        x, y = rng.standard_normal(n), np.zeros(n)
        for i in range(n):
            y[i] = sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k] * y[i - k] for k in (1, 2) if i >= k)
        assert np.allclose(K.recursed(x, (b, a)), y, atol=1e-9)
    high = K.lowpass(7000.0, 8000)  # a corner that the rate can't hold
    assert np.array_equal(K.recursed(x, high), K.apply_filter(x, high))


def test_packed_clips_are_mastered_alike(spark):
    from cadence.queries import timeline

    clips = [(k, (tone(200 + 300 * k, 0.5 + 0.1 * k, 0.2 + 0.1 * k)).astype(np.float32)) for k in range(5)]
    plain = spark.createDataFrame([(k, x.tolist()) for k, x in clips], "k int, samples array<float>").coalesce(1)
    tight = spark.createDataFrame([(k, bytearray(K.packed(x))) for k, x in clips], "k int, samples binary").coalesce(1)
    want = {r.k: r for r in M.master(plain, "podcast").collect()}
    for r in M.master(tight, "podcast").collect():
        assert np.array_equal(K.unpacked(bytes(r.samples)), np.asarray(want[r.k].samples)) and r.stages == want[r.k].stages
    a, b = (sorted(M.measures(M.master(df, "podcast"), ["k"], lufs=True).collect()) for df in (plain, tight))
    assert a == b
    # the query's samples go from pass to pass as bytes
    made = timeline.clips(spark, "/root/testdata/sf0.001", packed=True)
    rows = {r.user_id: r.samples for r in timeline.clips(spark, "/root/testdata/sf0.001").collect()}
    assert made.schema["samples"].dataType.typeName() == "binary" and all(np.array_equal(K.unpacked(bytes(r.samples)), np.asarray(rows[r.user_id])) for r in made.collect())
