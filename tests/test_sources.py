"""Files in, tables out: ragged records, words, messages, roles, WAV; reports, kernels and plans."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions import registry
from cadence.operators import metrics, signal, trajectory
from cadence.plans import staged
from cadence.sources import documents, records, sinks


def test_records(spark, tmp_path):
    doc = {"meta": 1, "videos": [{"video_id": "a", "Plays": "1,200", "metrics": {"likes": 5, "Me Gusta": "7"}, "retention": {"2s": "70%"}}, "no", {"title": "b", "views": None, "plays": 3}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    rows = records.canonical(records.flatten(records.read_json(spark, str(tmp_path / "m.json"))))
    got = {r["row_number"]: r for r in metrics.typed(rows).collect()}
    assert got[1]["id"] == "a" and got[1]["views"] == 1200.0 and got[1]["likes"] == 5.0 and got[1]["retention_2s"] == 0.7
    assert got[3]["id"] == "b" and got[3]["views"] is None  # the first name that is there wins, even with null
    (tmp_path / "m.csv").write_text("Título,Video ID,Reproducciones,Duración\nx,a,12,1:30\n")
    r = metrics.typed(records.read_csv(spark, str(tmp_path / "m.csv"))).first()
    assert (r["id"], r["views"], r["duration_s"]) == ("a", 12.0, 90.0)


def test_words(spark):
    texts = spark.createDataFrame([(1, '{"words":[{"w":"a","s":0,"e":1}]}'), (2, '{"segments":[{"words":[{"w":"b","s":0,"e":1}]},{},{"words":[{"w":"c","s":1,"e":2}]}]}'), (3, "{}")], "clip int, value string")
    assert sorted((r["clip"], r["pos"], r["w"]) for r in documents.words(texts).collect()) == [(1, 0, "a"), (2, 0, "b"), (2, 1, "c")]
    with pytest.raises(Exception, match="neither"):
        documents.words(texts, strict=True).collect()


def test_small_tables(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("coder\tw\tp\ts\td\ta\t\ntester\tw\tp\ts\td\ta\tbatch\n")
    assert {r["role"]: r["receive_mode"] for r in documents.roles(spark, str(tmp_path / "r.tsv")).collect()} == {"coder": "task", "tester": "batch"}
    (tmp_path / "w.conf").write_text("# note\n\nwindow a x wt batch -v\nwindow a y wt\nfoo b\n")
    got = sorted((r["role"], r["mode"], r["args"], r["errors"]) for r in documents.windows(spark, str(tmp_path / "w.conf")).collect())
    assert got == [("a", "batch", ["-v"], ["role twice"]), ("a", "task", [], ["role twice"]), ("b", "task", [], ["not a window", "too short"])]
    (tmp_path / "10_x").write_text("id: 1\nto: a\n\nhello")
    r = documents.messages(spark, str(tmp_path / "10_x")).first()
    assert r["name"] == "10_x" and r["headers"]["to"] == "a" and r["body"] == "hello"
    (tmp_path / "f.json").write_text('{"scenarios": []}')
    with pytest.raises(Exception, match="needs a name"):
        documents.features(spark, str(tmp_path / "f.json")).collect()


def test_wav(spark, tmp_path):
    x = (np.sin(np.arange(1000) / 10) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(48000), w.writeframes(np.stack([x, x], 1).tobytes())
    got = documents.wav(spark, str(tmp_path / "a.wav"), 400).orderBy("block").collect()
    assert [len(r["samples"]) for r in got] == [400, 400, 200] and np.allclose(np.concatenate([r["samples"] for r in got]), x / 32768, atol=1e-6)


def test_sinks(spark, tmp_path):
    assert sinks.report_json({"b": float("nan"), "a": [1.00004, True]}) == '{\n  "a": [\n    1.0,\n    true\n  ],\n  "b": null\n}\n'
    df = spark.createDataFrame([(2, "y"), (1, "x")], "i int, t string")
    assert df.transform(lambda d: sinks.document(d.withColumn("k", F.lit(1)), ["k"], "i", "t", "H\n")).first()["text"] == "H\nx\ny\n"
    assert "| 2 | y |" in sinks.report_markdown("r", {"t": df})
    sinks.tsv(df, str(tmp_path / "t"), "i")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1\t1\tx", "2\t2\ty"]
    vote = spark.createDataFrame([("a", "c")], "listener string, clip_id string")
    assert (sinks.append_vote(vote, str(tmp_path / "v")), sinks.append_vote(vote, str(tmp_path / "v"))) == (1, 2)


def test_kernels(spark):
    rate, t = 48_000, np.arange(96_000) / 48_000
    tone = 0.5 * np.sin(2 * np.pi * 997 * t)
    assert abs(signal.loudness(tone) - (-9.03)) < 0.2 and signal.loudness(tone[:100]) is None
    assert np.sqrt((signal.apply_filter(tone, signal.notch(997, rate))[30_000:] ** 2).mean()) < 0.01
    low = signal.apply_filter(tone, signal.lowpass(100, rate))
    assert np.abs(low[30_000:]).max() < 0.01 and abs(signal.band_db(tone, rate, 900, 1100) - 10 * np.log10(0.0625)) < 0.5
    # the filter is the recursion
    b, a = signal.peaking(1000, rate, 1.0, 6.0)
    x = np.random.default_rng(0).standard_normal(400)
    y = np.zeros(400)
    for i in range(400):
        y[i] = sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k] * y[i - k] for k in (1, 2) if i >= k)
    assert np.allclose(signal.apply_filter(x, (b, a)), y, atol=1e-9)
    clipped = np.clip(np.sin(np.arange(400) / 20), -0.8, 0.8)
    assert np.abs(signal.declip(clipped) - np.sin(np.arange(400) / 20)).max() < 0.1
    mixed = signal.mix_at(x / 10, np.ones(10), 50, -20.0, -6.0)
    assert np.array_equal(mixed[:50], x[:50] / 10) and np.array_equal(mixed[60:], x[60:] / 10)
    clips = spark.createDataFrame([(1, tone[:4800].tolist()), (2, [])], "clip int, samples array<float>")
    got = {r["clip"]: r for r in signal.measure(clips, ["clip"]).collect()}
    assert abs(got[1]["rms_db"] + 9.03) < 0.1 and got[2]["lufs"] is None
    assert len(signal.transform(clips, lambda v: v * 2).filter("clip = 1").first()["samples"]) == 4800


def test_similarity_products(spark):
    rng = np.random.default_rng(1)
    rows = [(1, i, 1 + rng.normal() / 10, rng.normal() / 10, rng.normal(), rng.normal()) for i in range(20)]
    got = trajectory.accumulate_similarity(spark.createDataFrame(rows, "k int, i int, a double, b double, tx double, ty double"), ["k"], "i").orderBy("i").collect()
    c = np.eye(3)
    for r, (_, _, a, b, tx, ty) in zip(got, rows):
        c = c @ np.linalg.inv(np.array([[a, -b, tx], [b, a, ty], [0, 0, 1]]))
        assert np.allclose([r["pa"], r["pb"], r["px"], r["py"]], [c[0, 0], c[1, 0], c[0, 2], c[1, 2]])


def test_plans(spark):
    double, one = ("double", lambda d: d.withColumn("id", F.col("id") * 2)), ("one", lambda d: d.limit(1))
    plan = staged.Plan([double, one])
    assert plan.describe() == ["1. double", "2. one"] and plan.run(spark.range(3)).count() == 1
    assert [(x["stage"], x["ok"], x["rows"]) for x in plan.log] == [("double", True, 3), ("one", True, 1)]
    # the first that fails ends the run, also where only its rows would tell
    late = lambda d: d.withColumn("id", F.raise_error(F.lit("no such clip")).cast("long"))
    for broken, why in ((lambda d: 1 / 0, "division by zero"), (late, "no such clip")):
        plan = staged.Plan([double, ("break", broken), one])
        with pytest.raises(staged.StageError, match="stage 2 .break. failed") as told:
            plan.run(spark.range(3))
        assert [x["ok"] for x in plan.log] == [True, False] and told.value.stage == "break" and why in plan.log[1]["error"]
    with pytest.raises(ValueError):
        staged.resolve_preset("loudest")
    brief = spark.createDataFrame([("TikTok", None, "odd", "buy", None, "no", None, "yes", None)], "platform string, objective string, archetype string, cta string, duration_s double, speech string, captions string, music string, source_assets array<string>")
    r = staged.edit_spec(brief).first()
    assert (r["platform"], r["archetype"], r["duration_s"], r["speech"], r["captions"], r["missing"]) == ("tiktok", "talking_head", 20.0, False, True, ["objective", "source_assets"])
    with pytest.raises(Exception, match="positive"):
        staged.edit_spec(brief.withColumn("duration_s", F.lit(-1.0))).collect()
    words = spark.createDataFrame([(1, 0, "a", 0.0, 1.234), (1, 1, "b", 2.0, 3.456)], "clip int, pos int, w string, s double, e double")
    a, b = staged.rule_plan(words, ["clip"]), staged.rule_plan(words, ["clip"], 30.0)
    assert a.first()["effects"][0]["args"] == {"hit": "3.46"} and [r["column"] for r in staged.compare(a, b, ["clip"], ["level", "max_dur"]).collect()] == ["max_dur"]
    notes = trajectory.riser(4, 2.0)
    assert abs(sum(d for _, d in notes) - 2.0) < 1e-12 and notes[1][0] == notes[0][1]


def test_registry(spark):
    registry.register("plain", lambda gain=1: ("plain", gain))
    assert registry.engine("plain", gain=2) == ("plain", 2) and registry.engine("none") is None and "plain" in registry.names()
    registry.to_spark(spark, {"plus_one": F.pandas_udf(lambda s: s + 1, "long")})
    assert spark.sql("select plus_one(2) as x").first()["x"] == 3
