"""Window forms against small sequential models, and literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from cadence.operators import cues, frames, intervals, messages, metrics, scenarios, trajectory, votes


def spans(rng, n):
    return [(rng.randrange(3), a := rng.randrange(100), a + rng.randrange(1, 12)) for _ in range(n)]


def merged(rows, slack=0):
    out = []
    for k in sorted({r[0] for r in rows}):
        own = []
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if own and a <= own[-1][1] + slack:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
        out += [(k, a, b) for a, b in own]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_trim_and_cuts(spark, seed):
    rows = spans(random.Random(seed), 30)
    df = spark.createDataFrame(rows, "k int, start long, end long")
    got = intervals.merge(df, ["k"])
    want = merged(rows)
    assert sorted(tuple(r)[:3] for r in got.collect()) == want
    kept = []
    for k in {r[0] for r in want}:
        own = [r for r in want if r[0] == k]
        kept += own
        for (_, _, a), (_, b, _) in zip(own, own[1:]):
            kept.append((k, a, a + 3 if b - a > 8 else b))
    parts = intervals.keep_parts(got.select("k", "start", "end"), ["k"], 8, 3)
    assert sorted(tuple(r)[:3] for r in parts.collect()) == merged(kept)
    cut = {r["k"]: (r["cuts"], r["kept"]) for r in intervals.cuts(parts, ["k"]).collect()}
    for k, (n, total) in cut.items():
        own = [r for r in merged(kept) if r[0] == k]
        assert (n, total) == (len(own) - 1, sum(b - a for _, a, b in own))


def test_trim_boundaries(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.8, 2.0), (1, 2.81, 3.0)], "k int, start double, end double")
    gaps = {round(r["start"], 2): round(r["end"] - r["start"], 2) for r in intervals.trim(df, ["k"], 0.8, 0.5).filter("kind = 'gap'").collect()}
    assert gaps == {1.0: 0.8, 2.0: 0.5}


def test_runs_and_rejection(spark):
    flags = [True, True, False, True, None, True, True, True]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k int, i int, f boolean")
    assert sorted(tuple(r)[1:] for r in intervals.runs(df, ["k"], "i", F.col("f")).collect()) == [(0, 1, 2), (3, 3, 1), (5, 7, 3)]
    a = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 3.0)], "k int, start double, end double")
    b = spark.createDataFrame([(1, 0.6, 2.3)], "k int, start double, end double")
    assert [r["start"] for r in intervals.reject_overlaps(a, b, ["k"], 0.35).collect()] == [2.0]
    kept = intervals.self_apart(spark.createDataFrame([(1, 0.0, 1.0, 0), (1, 0.5, 2.0, 1), (1, 1.0, 2.0, 2)], "k int, start double, end double, o int"), ["k"], "o", "k int, start double, end double, o int")
    assert sorted(r["o"] for r in kept.collect()) == [0, 2]


def test_spacing(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), i * 1.0, float(rng.randrange(50))) for i in range(60)]
    want = set()
    for k in (0, 1):
        chosen = []
        for _, t, w in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], -r[1])):
            if len(chosen) < 4 and all(abs(t - c) >= 5 for c in chosen):
                chosen.append(t)
                want.add((k, t, w))
    got = intervals.spaced(spark.createDataFrame(rows, "k int, t double, w double"), ["k"], "t", "w", 5, 4)
    assert {tuple(r) for r in got.collect()} == want


def test_packing(spark):
    pts = spark.createDataFrame([(1, t) for t in (0, 5, 10, 14, 30)], "k int, t int")
    kept = spark.createDataFrame([(1, 0, 6), (1, 10, 15)], "k int, start int, end int")
    assert sorted(tuple(r) for r in intervals.inside(pts, kept, ["k"], "t").select("t", "packed").collect()) == [(0, 0), (5, 5), (10, 6), (14, 10)]


def test_scores(spark):
    null = F.lit(None).cast("double")
    row = spark.range(1).select(
        frames.noise_score(null).alias("a"), frames.noise_score(F.lit(40.0)).alias("b"), frames.room_score(null, F.lit(0.5)).alias("c"), frames.room_score(F.lit(3.0), F.lit(1.0)).alias("d"),
        frames.dynamics_score(null, null).alias("e"), frames.dynamics_score(null, F.lit(11.0)).alias("f"), frames.verdict(F.lit(80.0)).alias("g"), frames.reverb_label(F.lit(0.5)).alias("h"),
    ).first()
    assert tuple(row) == (50.0, 100.0, 60.0, 60 * 0.7 + 30 * 0.3, 60.0, 100.0, "good", "medium")


def test_partial_frames_are_dropped(spark):
    df = spark.range(10).select((F.col("id") * 1).alias("i"), F.lit(1.0).alias("x"))
    assert [r["frame"] for r in frames.levels(df, [], "i", "x", 4).collect()] == [0, 1]


def test_metrics_of_ragged_rows(spark):
    raw = spark.createDataFrame([("a", "0", "10", "5", "70%"), ("b", "100", None, "50", "1.2"), ("c", None, None, None, "x")], "id string, views string, reach string, likes string, retention_2s string")
    rows = {r["id"]: r for r in metrics.score(metrics.derive(metrics.typed(raw)), "engagement").collect()}
    assert rows["a"]["like_rate"] == 0.5 and rows["a"]["retention_2s"] == 0.7 and rows["b"]["retention_2s"] == 0.012
    assert rows["b"]["engagement_rate"] == 0.5 and rows["b"]["share_rate"] is None and rows["b"]["goal_score"] == 0.5 and rows["c"]["goal_score"] is None
    missing = {r["field"]: r["present"] for r in metrics.missing_for_goal(metrics.typed(raw), "engagement").collect()}
    assert missing == {"comments": 0, "shares": 0, "saves": 0}


def test_keyframes(spark):
    k = spark.range(1).select(F.explode(trajectory.parse_keyframes(F.lit("1:4,8;0:0,0 ; 0.5=2,2,90,50;"))).alias("k")).select("k.*")
    assert [tuple(r) for r in k.collect()] == [(0.0, 0.0, 0.0, 0.0, 100.0), (0.5, 2.0, 2.0, 90.0, 50.0), (1.0, 4.0, 8.0, 0.0, 100.0)]
    p = spark.createDataFrame([(-1.0,), (0.0,), (0.25,), (0.5,), (0.75,), (2.0,)], "p double")
    assert [r["x"] for r in trajectory.interpolate(p, k, "p").orderBy("p").collect()] == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0]


def test_phases_and_transforms(spark):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: trajectory.phase(i, F.lit(2), F.lit(15), 3, 4, 3)).alias("p")).first()["p"]
    assert row == [None, None] + ["white_a"] * 3 + ["empty"] * 2 + ["appear"] * 2 + ["white_b"] * 3 + ["after"] * 3
    with pytest.raises(Exception, match="singular"):
        spark.range(1).select(trajectory.invert(*[F.lit(0.0)] * 4).alias("i")).collect()


def test_smoothing_repeats_ends(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 1, 1, 5, 1])], "k int, i int, v double")
    got = [r["smooth"] for r in trajectory.smooth(df, ["k"], "i", "v", 1.0).orderBy("i").collect()]
    w = [2.718281828459045 ** (-0.5 * k * k) for k in range(-4, 5)]
    v = [1, 1, 1, 5, 1]
    want = [sum(x * v[min(max(i + k, 0), 4)] for k, x in zip(range(-4, 5), w)) / sum(w) for i in range(5)]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-12


def test_lines_back_up_to_a_good_end():
    words = [("uno,", 0.0, 0.3, True, False), ("dos", 0.3, 0.6, False, False), ("para", 0.6, 0.9, False, True), ("x" * 30, 0.9, 3.0, False, False)]
    assert cues.fold_lines(words, 17.0) == [0, 1, 1, 1] or cues.fold_lines(words, 17.0) == [0, 1, 1, 2]
    assert cues.fold_lines([], 17.0) == [] and cues.fold_lines(words[:1], 0.0) == [0]


def test_audit(spark):
    df = spark.createDataFrame([(1, 21, 0.0, 1.0), (2, 19, 0.0, 1.0), (3, 10, 0.0, 0.8), (4, 5, 1.0, 1.0)], "i int, chars int, s double, e double")
    assert sorted((r["i"], r["severity"], r["rule"]) for r in cues.audit(df).collect()) == [(1, "fail", "pace"), (2, "warn", "pace"), (3, "warn", "short"), (4, "fail", "pace"), (4, "warn", "short")]


def test_messages(spark):
    text = "id: 7\nto: a,b\nid: 8\n\nbody\n\nmore"
    m = spark.range(1).select(messages.parse(F.lit(text)).alias("m")).first()["m"]
    assert m["headers"] == {"id": "7", "to": "a,b"} and m["body"] == "body\n\nmore"
    bad = spark.range(1).select(messages.line_errors(F.lit("to: a\nnope\nx: \nid: 1\nzip: 2\nto: b\n\nrest"), ["id"], ["to"]).alias("e")).first()["e"]
    assert [(e["line"], e["error"]) for e in bad] == [(2, "not a header"), (3, "empty"), (4, "reserved"), (5, "unknown"), (6, "duplicate"), (8, "body not allowed")]
    shown = spark.range(1).select(messages.render(messages.upsert(F.create_map(*[F.lit(x) for x in ("b", "1", "id", "2", "a", "3")]), "b", F.lit("9")), ["id", "to"]).alias("t")).first()["t"]
    assert shown == "id: 2\na: 3\nb: 9"


def test_fan_out_and_batches(spark):
    rows = spark.createDataFrame([(1, "a,b", "r", "2"), (2, "a,zz", "r", "1"), (3, "b", "r", "1"), (4, "b", "q", "5")], "id long, to string, role string, priority string")
    good, failed = messages.fan_out(rows, spark.createDataFrame([("a",), ("b",)], "role string"))
    assert sorted((r["id"], r["recipient"]) for r in good.collect()) == [(1, "a"), (1, "b"), (3, "b"), (4, "b")] and [r["id"] for r in failed.collect()] == [2]
    assert messages.undelivered(good, good).count() == 0
    assert sorted(r["id"] for r in messages.next_batch(rows, "role", "priority").collect()) == [2, 3, 4]
    numbered = messages.sequence(rows, ["priority", "id"], 10)
    assert [r["id"] for r in numbered.orderBy("sequence").collect()] == [2, 3, 1, 4] and numbered.agg(F.min("sequence"), F.max("sequence")).first() == (11, 14)


def test_scenarios_run(spark):
    doc = '{"name": "f", "scenarios": [{"name": "s", "steps": [{"keyword": "Given", "text": "set <n>"}, {"keyword": "Then", "text": "is 3"}], "examples": [{"n": "3"}, {"n": "4"}]}, {"name": "t", "steps": [{"keyword": "x", "text": "what"}]}]}'
    e = scenarios.expand(spark.range(1).select(F.from_json(F.lit(doc), scenarios.FEATURE).alias("f")).select("f.*"))
    handlers = {r"set (\d+)": lambda w, m: w.update(n=int(m[1])), r"is (\d+)": lambda w, m: None if w["n"] == int(m[1]) else 1 / 0}
    got = {(r["scenario_index"], r["example_index"]): r["ok"] for r in scenarios.run(e, handlers).collect()}
    assert got == {(0, 1): True, (0, 2): False, (1, 1): False}


def test_votes(spark):
    files = spark.createDataFrame([("a", "c", "p", "x_A.wav", "x_B.wav", "A", "y", "5", "1", "")], votes.FILES)
    server = spark.createDataFrame([("b", "c", "tie", "y", "3", "3", "", "t")], votes.SERVER)
    both = votes.unify(files, server)
    assert both.count() == 2 and "clip_id" in both.columns
    assert {r["condition"]: r["mos"] for r in votes.opinion(files).collect()} == {"A": 5.0, "B": 1.0}
