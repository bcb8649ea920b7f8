"""Ordered work on keys that are cut, and names that don't clash."""

import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from cadence.operators import frames, intervals, motion, ranges
from cadence.sources import sinks
from cadence.streaming import events


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [("big", k, rng.choice([0.0, 1.0, 2.0, 5.0])) for k in range(0, 900, 1)] + [("small", 7, 1.0), (None, 3, 2.0), (None, 4, 5.0)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, t long, v double").repartition(7)


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(ranges, "CHUNK", 16)
    monkeypatch.setattr(ranges.chunked, "__defaults__", (16,))


def _by_key(data):
    out = {}
    for k, t, v in sorted(data, key=lambda r: (r[0] or "", r[1])):
        out.setdefault(k, []).append((t, v))
    return out


def test_places(rows):
    data, df = rows
    got = {(r.k, r.t): r.place for r in ranges.placed(df, ["k"], ["t"]).collect()}
    assert got == {(k, t): n for k, own in _by_key(data).items() for n, (t, _) in enumerate(own)}
    assert sorted(r.place for r in ranges.placed(df, [], ["k", "t"]).collect()) == list(range(len(data)))


def test_quantiles_are_those_of_duckdb_to_the_last_place(spark):
    rng = random.Random(4)
    data = [(k, round(rng.expovariate(0.02), 2)) for k in range(400) for _ in range(1 + k % 40)] + [(0, None), (-1, None)]
    # an upper quartile of 55.56: 43.56 is not above it less 12
    data += [(-2, v) for v in [1.0, 43.56, *[53.0] * 51, 54.61, *[58.41] * 18]]
    df = spark.createDataFrame(data, "k int, v double").repartition(5)
    con = duckdb.connect()
    con.execute("create table t (k int, v double)")
    con.executemany("insert into t values (?, ?)", data)
    for share in (0.75, 0.1, 0.5, 1.0):
        want = con.execute(f"select k, quantile_cont(v, {share}) from t group by k").fetchall()
        assert {r.k: r["quantile"] for r in ranges.quantiles(df, ["k"], "v", share).collect()} == dict(want)
    got = {(r.k, r.v): r.active for r in frames.active(df, ["k"], "v").collect()}
    assert got[(-2, 43.56)] is False and got[(-2, 53.0)] is True and got[(-1, None)] is None
    want = con.execute("select k, v, v > greatest(-50, q - 12) from t join (select k, quantile_cont(v, 0.75) as q from t group by k) using (k)").fetchall()
    assert all(got[(k, v)] == on for k, v, on in want)


def test_windows_over_cut_keys(rows):
    data, df = rows
    got = {(r.k, r.t): (r.median, r.v) for r in frames.rolling_median(df, ["k"], "t", "v", 5).collect()}
    assert len(got) == len(data)
    for k, own in _by_key(data).items():
        for n, (t, v) in enumerate(own):
            assert got[(k, t)] == (statistics.median([x for _, x in own[max(0, n - 5) : n + 6]]), v)
    wide = frames.rolling_median(df, ["k"], "t", "v", 40)  # wider than a chunk
    assert wide.count() == len(data)
    smooth = {(r.k, r.t): r.smooth for r in frames.moving_average(df, ["k"], "t", "v", 6).collect()}
    own = _by_key(data)["big"]
    assert all(abs(smooth[("big", t)] - sum(x for _, x in own[max(0, n - 3) : n + 3]) / 6) < 1e-12 for n, (t, _) in enumerate(own))


def test_runs_over_cut_keys(rows):
    data, df = rows
    got = sorted(((r.k, r["first"], r["last"], r.length) for r in intervals.runs(df, ["k"], "t", F.col("v") > 0.5).collect()), key=str)
    want = []
    for k, own in _by_key(data).items():
        run = []
        for t, v in [*own, (None, 0.0)]:
            if v > 0.5:
                run.append(t)
            elif run:
                want.append((k, run[0], run[-1], len(run)))
                run = []
    assert got == sorted(want, key=str)
    one = intervals.consecutive(df, ["k"], "t").filter("k = 'big'").collect()
    assert [(r["first"], r["last"], r.length) for r in one] == [(0, 899, 900)]


def test_followers_over_cut_keys(rows):
    data, df = rows
    got = {(r.k, r.t): r.smooth for r in events.smooth_levels(df.filter("k is not null"), "k", "t", "v", 0.5, 0.1).collect()}
    for k, own in _by_key(data).items():
        state = 1.0
        for t, v in own if k else []:
            state += (0.5 if v < state else 0.1) * (v - state)
            assert abs(got[(k, t)] - state) < 1e-12
    assert len(got) == 901


def test_message_names_sort_and_differ(spark):
    df = spark.createDataFrame([(n,) for n in (7, 999_999, 1_000_000, 1_000_001)], "n long").select("n", sinks.message_name(F.lit("1"), F.lit("2024-01-02").cast("timestamp"), F.col("n"), F.lit("a"), F.lit("b")).alias("name"))
    names = [r.name.split("_")[2] for r in df.orderBy("n").collect()]
    assert names == ["000007", "999999", "1000000", "1000001"]


def test_archive_names_are_not_taken(spark):
    taken = spark.createDataFrame([("a",), ("a.1",), ("b.7",)], "name string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("b", 4), ("c", 5), ("c", 6), ("c.1", 7), ("a.1", 8)], "name string, at long")
    got = {r.at: r.archived for r in motion.archived(new, taken).collect()}
    assert got == {1: "a.2", 2: "b", 3: "a.3", 4: "b.8", 5: "c", 6: "c.2", 7: "c.1", 8: "a.1.1"}


def _greedy(own):
    last, out = float("-inf"), []
    for s, e, i in sorted(own):
        if s >= last:
            out.append(i)
            last = e
    return out


def test_first_come_over_cut_keys(spark, monkeypatch):
    from cadence.operators import blocks

    monkeypatch.setattr(blocks, "SPAN", 3)
    rng = random.Random(7)
    data = [("big", float(rng.randrange(3000)), k) for k in range(700)] + [("one", 1.0, 1000), ("none", 5.0, 1001), ("none", 5.0, 1002)]
    rows = [(k, s, s + rng.choice([0.5, 3.0, 40.0, 400.0]), i) for k, s, i in data]
    df = spark.createDataFrame(rows, "k string, start double, end double, i long").repartition(5)
    got = {r.i for r in intervals.self_apart(df, ["k"], "start", "").collect()}
    want = {i for key in ("big", "one", "none") for i in _greedy([(s, e, i) for k, s, e, i in rows if k == key])}
    ties = lambda ids: sorted((k, s, e) for k, s, e, i in rows if i in ids)
    assert ties(got) == ties(want) and len(got) > 15


def test_step_maps_compose():
    import numpy as np

    rng = np.random.default_rng(4)
    s = np.sort(rng.integers(0, 300, 60)).astype(float)
    e = s + rng.choice([1.0, 7.0, 60.0], 60)
    parts = [np.array(intervals.step_map(s[a:b], e[a:b])) for a, b in ((0, 20), (20, 45), (45, 60))]
    whole = intervals.step_after(intervals.step_after(parts[0], parts[1]), parts[2])
    for t in [-1.0, *np.arange(0, 400, 0.5)]:
        last = t
        for x, y in zip(s, e):
            last = y if x >= last else last
        assert intervals.step_apply(whole, np.array([t]))[0] == last == intervals.step_apply(np.array(intervals.step_map(s, e)), np.array([t]))[0]


def test_spaced_in_rounds(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(200), float(rng.randrange(20))) for k in ("a", "b", None) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, t long, w double").repartition(4)
    got = sorted(((r.k, r.t, r.w) for r in intervals.spaced(df, ["k"], "t", "w", 17, 10).collect()), key=str)
    want = []
    for key in ("a", "b", None):
        chosen = []
        for _, t, w in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], -r[1])):
            if len(chosen) < 10 and all(abs(t - c) >= 17 for c, _ in chosen):
                chosen.append((t, w))
        want += [(key, t, w) for t, w in chosen]
    assert got == sorted(want, key=str)
    assert intervals.spaced(df, ["k"], "t", "w", 0, 3).count() == 9


def test_overlaps_are_the_longest(spark):
    rng = random.Random(9)
    spans = [(k, float(s), float(s + rng.randrange(1, 40)), i) for i, (k, s) in enumerate((rng.choice("ab"), rng.randrange(300)) for _ in range(120))]
    busy = [(k, float(s), float(s + rng.choice([1, 5, 30, 80]))) for k, s in ((rng.choice("abc"), rng.randrange(300)) for _ in range(90))]
    got = {r.i: r.overlap for r in intervals.overlap_notes(spark.createDataFrame(spans, "k string, start double, end double, i long"), spark.createDataFrame(busy, "k string, start double, end double"), ["k"], 2.0).collect()}
    for k, s, e, i in spans:
        best = max([min(e, y) - max(s, x) for key, x, y in busy if key == k], default=0)
        assert got[i] == (best if best > 2 else None)
    assert len(got) == len(spans)
