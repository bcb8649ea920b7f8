"""Motion against hand-worked values."""

import pytest
from pyspark.sql import functions as F

from cadence.operators import motion as M
from cadence.operators import trajectory as T


def test_grammars(spark):
    df = spark.createDataFrame([("10,-20", "2-3-4", None), ("101,0", "0-1-1", "-91,0"), ("a,b", "2-2", "5"), (None, None, "-30, 12.5")], "m string, p string, s string")
    got = [tuple(r) for r in df.select(M.parse_move(F.col("m")), M.parse_pattern(F.col("p")), M.parse_shift(F.col("s"))).collect()]
    assert got == [([10.0, -20.0], [2, 3, 4], [-25.0, 0.0]), (None, None, None), (None, None, None), (None, [2, 2, 2], [-30.0, 12.5])]


def test_pose(spark):
    t = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.5,)], "t double")
    got = [tuple(r["p"]) for r in t.select(M.levitation(F.col("t"), 1.0, 1.0, lift=10.0, scale=-90.0, bob=2.0, easing="linear").alias("p")).collect()]
    assert got[:3] == [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 1.0), (0.0, -5.0, 0.0, 0.55)] and got[3][1] == pytest.approx(-8.0) and got[3][3] == 0.25
    with pytest.raises(ValueError, match="frame's size"):
        M.levitation(F.col("t"), 1.0, 1.0, pose=F.col("t"))


def test_lens_and_moments(spark):
    g = spark.range(1).select(M.lens(F.lit(1920), F.lit(1080), F.lit(0.1), F.lit(2.0), F.lit(0.1), F.lit(0.02)).alias("g")).first()["g"]
    assert (g["radius"], g["win"], g["crop"], g["zoom_eff"], g["fits"]) == (108, 240, 108, 2.0, True)
    kept = M.moments_kept(spark.createDataFrame([(4.4,), (4.6,), (9.0,), (15.6,)], "at double"), "at", F.lit(5.0), F.lit(10.0))
    assert [round(r["at"], 2) for r in kept.collect()] == [-0.4, 4.0]


def test_names_and_archive(spark):
    df = spark.createDataFrame([("code_review-lead", "a", 1), ("x", "a", 2), ("y", "b", 3)], "role string, name string, at int")
    assert [r[0] for r in df.select(M.display_name(F.col("role"))).collect()] == ["Code Review Lead", "X", "Y"]
    taken = spark.createDataFrame([("b",), ("b",)], "name string")
    assert {r["at"]: r["archived"] for r in M.archived(df, taken).collect()} == {1: "a", 2: "a.1", 3: "b.2"}


def test_keyframes_by_halving(spark):
    points = spark.createDataFrame([(p,) for p in (-1.0, 0.0, 0.1, 0.25, 0.6, 1.0, 2.0)], "p double")
    for n in (2, 3, 7, 50):
        track = spark.createDataFrame([(k / (n - 1), float(k * k), 0.0, 0.0, 0.0) for k in range(n)], "progress double, x double, y double, rotation double, scale double")
        for r in T.interpolate(points, track, "p").collect():
            p = min(max(r["p"], 0.0), 1.0) * (n - 1)
            k = min(int(p), n - 2)
            assert r["x"] == pytest.approx(k * k + (p - k) * (2 * k + 1))
    assert T.interpolate(points, track.limit(1), "p").count() == 0


def test_similarities_are_fitted_without_outliers(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = []
    for f in range(4):
        x = rng.normal(0, 50, (30, 2))
        a, b, t = 1 + f / 50, f / 40, np.array([f * 2.0, -f])
        y = x @ np.array([[a, b], [-b, a]]) + t + rng.normal(0, 0.01, x.shape)
        y[:6] += rng.uniform(20, 60, (6, 2))
        rows += [(f, *map(float, p), *map(float, q)) for p, q in zip(x, y)]
    rows += [(8, 0.0, 0.0, 1.0, 1.0), (8, 1.0, 0.0, 2.0, 1.0), (9, 3.0, 3.0, 4.0, 4.0), (9, None, 3.0, 4.0, 4.0)] + [(10, 1.0, 1.0, float(k), 2.0) for k in range(9)]
    df = spark.createDataFrame(rows, "frame int, x double, y double, u double, v double").repartition(3)
    got = {r.frame: r for r in M.similarity_fit(df, ["frame"]).collect()}
    for f in range(4):
        r = got[f]
        assert abs(r.a - 1 - f / 50) < 1e-3 and abs(r.b - f / 40) < 1e-3 and abs(r.tx - f * 2) < 0.05 and abs(r.ty + f) < 0.05 and r.inliers <= 24 and r.points == 30
    assert got[8].a is None and got[9].a is None and got[9].points == 1 and got[10].a is None
    path = spark.createDataFrame([(k, 0, *([0.9, 0.1, float(k), 0.0] if k in (2, 6) else [None] * 4)) for k in range(8)], "frame int, clip int, a double, b double, tx double, ty double")
    t = {r.frame: r for r in M.trajectory(path, ["clip"], "frame", every=5).collect()}
    assert [t[k].carried for k in range(8)] == [1, 2, 0, 1, 2, 3, 0, 1] and [t[k].tx for k in range(8)] == [0, 0, 2, 2, 2, 2, 6, 6]
    assert [k for k in range(8) if t[k].detect] == [0, 1, 4, 5] and t[0].a == 1.0


def test_tracks_of_their_own(spark):
    from cadence.operators import trajectory as T

    keys = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 4.0), ("a", 0.5, 10.0), ("a", 1.0, 0.0), ("b", 0.2, 1.0), ("b", 0.8, 2.0)], "k string, progress double, x double")
    asked = [("a", -1.0), ("a", 0.0), ("a", 0.25), ("a", 0.5), ("a", 0.75), ("a", 2.0), ("b", 0.1), ("b", 0.2), ("b", 0.5), ("b", 0.9), ("c", 0.5)]
    points = spark.createDataFrame([(k, p, i) for i, (k, p) in enumerate(asked)], "k string, p double, i int").repartition(3)
    got = {r.i: r.x for r in T.interpolate_tracks(points, keys, ["k"], "p", ["x"]).collect()}
    # two keyframes at 0: a point there is at the first, later ones start from the last
    assert got == {0: 0.0, 1: 0.0, 2: 7.0, 3: 10.0, 4: 5.0, 5: 0.0, 7: 1.0, 8: 1.5}
    one = T.interpolate(points.filter("k = 'a'"), keys.filter("k = 'a'"), "p", ["x"])
    assert one.count() == 6


def test_chords_take_places_of_their_scale():
    import numpy as np

    from cadence.operators import tones

    steps = {m: tones.chord(tones.Mood(**{**tones.mood_of("hope").__dict__, "mode": m})) - tones.mood_of("hope").tonic for m in ("major", "pentatonic_major", "pentatonic_minor")}
    assert steps["major"].tolist() == [0, 4, 7] and steps["pentatonic_major"].tolist() == [0, 4, 9] and steps["pentatonic_minor"].tolist() == [0, 5, 10]
    # C major to A minor: two notes stay
    near = tones.nearest_voicing(np.array([60, 64, 67]), np.array([57, 60, 64]))
    assert sorted(near.tolist()) == [60, 64, 69]
