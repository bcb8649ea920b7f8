"""Whole edit documents, and pauses of several recordings."""

import json

import numpy as np

from cadence.operators import mastering as M
from cadence.plans.documents import ARCHETYPES, BEATS, ELSEWHERE, FIELDS, READY, edit_document, markdown


def test_documents_of_briefs(spark):
    schema = "platform string, objective string, archetype string, hook_type string, cta string, duration_s double, speech string, captions string, music string, source_assets string, transcript_or_timecodes string"
    rows = [("TikTok", "sales", "tutorial", "question", "subscribe", 24.0, "yes", None, "no", "a.mp4", "w.json"), (None, None, "odd", None, None, None, "no", None, None, None, " "), ("vimeo", "", None, "", "", 6.0, None, "no", "yes", "[]", "w.json"), ("shorts", "x", "reaction", "face", "buy", 0.9, None, None, None, "a", None)]
    one, two, three, four = (r.document.asDict(recursive=True) for r in edit_document(spark.createDataFrame(rows, schema)).collect())
    assert one["brief"] == {"platform": "tiktok", "objective": "sales", "archetype": "tutorial", "duration_s": 24.0, "hook_type": "question", "cta": "subscribe"}
    assert [b["beat"] for b in one["timeline"]] == ["hook", "promise", "proof", "progression", "payoff_cta"] and one["next_input"] == [READY]
    assert one["timeline"][0]["start_s"] == 0 and one["timeline"][-1]["end_s"] == 24.0 and all(a["end_s"] == b["start_s"] for a, b in zip(one["timeline"], one["timeline"][1:]))
    assert "question" in one["timeline"][0]["source_request"] and "subscribe" in one["timeline"][-1]["text"] and one["timeline"][2]["edit"] == ARCHETYPES["tutorial"][0]
    assert (one["captions"]["enabled"], one["audio"]["speech"], one["audio"]["music"]) == (True, True, False)
    # what is left out
    assert two["brief"] == {"platform": "tiktok", "objective": "retention", "archetype": "odd", "duration_s": 20.0, "hook_type": "result_first", "cta": "none"}
    assert two["strategy"]["cut_policy"] == ARCHETYPES["talking_head"][0] and two["captions"]["enabled"] is False and two["next_input"] == ["source_assets", "transcript_or_timecodes"]
    assert two["audio"]["priority"] == "music > effects"
    assert three["platform_note"] == ELSEWHERE and [b["beat"] for b in three["timeline"]] == ["hook", "promise", "proof", "payoff"] and three["captions"]["enabled"] is False and three["next_input"] == ["source_assets"]
    assert [b["beat"] for b in four["timeline"]] == ["hook"] and four["timeline"][0]["end_s"] == 0.7
    for d in (one, two, three, four):
        assert "{" not in json.dumps(d["timeline"]) .replace('{"', "").replace(", {", "").replace("[{", "") and all(b[f] for b in d["timeline"] for f in FIELDS)
    text = markdown(one)
    assert text.startswith("# Edit\n") and text.count("\n| ") == 1 + 5 and "* [ ] " in text
    assert set(BEATS) >= {b["beat"] for d in (one, two, three, four) for b in d["timeline"]}


def test_pauses_of_each_recording(spark):
    rate = 8000
    rng = np.random.default_rng(1)
    speech = lambda s: 0.3 * np.sin(2 * np.pi * 300 * np.arange(round(s * rate)) / rate)
    quiet = lambda s: rng.normal(0, 1e-4, round(s * rate))
    clips = {"a": np.concatenate([speech(1), quiet(2), speech(1)]), "b": np.concatenate([quiet(0.2), speech(2), quiet(0.6), speech(1)]), "c": quiet(3.0)}
    df = spark.createDataFrame([(k, x.tolist()) for k, x in clips.items()], "path string, samples array<float>").repartition(3)
    got = {r.path: np.array(r.samples) for r in M.without_pauses(df, ["path"], *M.PAUSES["medium"], rate=rate).collect()}
    assert abs(len(got["a"]) - 2.5 * rate) <= 0.03 * rate  # two seconds become half a second
    assert len(got["b"]) == len(clips["b"]) and len(got["c"]) == len(clips["c"])
    tight = {r.path: len(r.samples) for r in M.without_pauses(df, ["path"], *M.PAUSES["aggressive"], rate=rate).collect()}
    assert abs(tight["b"] - (len(clips["b"]) - 0.3 * rate)) <= 0.03 * rate
