"""Recordings over many rows against one pass over the whole."""

import numpy as np
import pytest

from cadence.operators import blocks as B
from cadence.operators import mastering as M
from cadence.operators import signal as K


def _blocks(spark, recordings, size):
    rows = [(name, k, x[a : a + size].tolist()) for name, x in recordings.items() for k, a in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, "path string, block long, samples array<double>").repartition(5)


def _whole(df):
    out = {}
    for r in sorted(df.select("path", "block", "samples").collect()):
        out.setdefault(r.path, []).append(np.array(r.samples, float))
    return {k: np.concatenate(v) for k, v in out.items()}


def _plain(x, sections):
    for b, a in sections:
        b, a = (np.pad(np.asarray(v, float), (0, 3 - len(v))) for v in (b, a))
        one = two = 0.0
        out = np.empty(len(x))
        for i, v in enumerate(x):
            y = b[0] * v + one
            one, two = b[1] * v - a[1] * y + two, b[2] * v - a[2] * y
            out[i] = y
        x = out
    return x


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(6)
    t = np.arange(30_000) / 48_000
    return {"noise": rng.normal(0, 0.2, 30_000), "tone": 0.5 * np.sin(2 * np.pi * 440 * t) + 0.1, "short": rng.normal(0, 0.2, 700), "one": np.array([0.3])}


def test_filters_go_on_from_block_to_block(spark, recordings, monkeypatch):
    monkeypatch.setattr(B, "SPAN", 4)  # several spans a recording
    sections = (K.dc_block(48_000), K.highpass(80.0, 48_000), K.notch(50.0, 48_000), K.peaking(3200.0, 48_000, 0.8, 3.0))
    got = _whole(B.filtered(_blocks(spark, recordings, 1000), ["path"], *sections))
    assert got.keys() == recordings.keys()
    for name, x in recordings.items():
        assert np.allclose(got[name], _plain(x, sections), atol=1e-9), name


def test_followers_go_on_from_block_to_block(spark, monkeypatch):
    monkeypatch.setattr(B, "SPAN", 4)
    rng = np.random.default_rng(3)
    gains = {"a": rng.random(5000), "b": np.where(rng.random(900) < 0.1, 0.2, 1.0), "c": np.ones(50), "d": np.zeros(7)}
    got = _whole(B.followed(_blocks(spark, gains, 60), ["path"], 0.4, 0.03))
    for name, g in gains.items():
        assert np.allclose(got[name], M.follow(g, 0.4, 0.03), atol=1e-12), name


def test_follower_maps_compose():
    rng = np.random.default_rng(1)
    f = B.Follower(0.3, 0.05, 0.0, 1.0)
    a, b = rng.random(40), rng.random(25)
    both = f.compose(f.map(a), f.map(b))
    for s in np.linspace(0, 1, 57):
        assert abs(f.apply(f.map(a), s) - f.run(a, s)[-1]) < 1e-12
        assert abs(f.apply(both, s) - f.run(np.concatenate([a, b]), s)[-1]) < 1e-12


def test_halos_reach_over_blocks(spark):
    x = np.arange(23.0)
    rows = {r.block: r for r in B.haloed(_blocks(spark, {"a": x}, 5), ["path"], 5, 7, 12).collect()}
    assert len(rows) == 5
    for k, r in rows.items():
        a, b = 5 * k, min(23, 5 * k + 5)
        assert list(r.head) == x[max(0, a - 7) : a].tolist() and list(r.samples) == x[a:b].tolist() and list(r.tail) == x[b : b + 12].tolist()


@pytest.mark.parametrize("rate", [16_000, 22_050, 44_100])
def test_resampling_keeps_tones_and_stops_aliases(spark, rate):
    t = np.arange(rate) / rate
    out = _whole(B.resampled(_blocks(spark, {"low": np.sin(2 * np.pi * 1000 * t)}, 3000), ["path"], 3000, rate, 48_000))["low"]
    assert len(out) == 48_000
    want = np.sin(2 * np.pi * 1000 * np.arange(48_000) / 48_000)
    assert np.abs(out - want)[500:-500].max() < 2e-3
    power = np.abs(np.fft.rfft(out[4800:-4800])) ** 2
    images = power[np.fft.rfftfreq(len(out) - 9600, 1 / 48_000) > 2000].sum() / power.sum()
    assert images < 1e-5
    if rate == 44_100:
        return
    # down again: what the lower rate can't hold is gone
    high = np.sin(2 * np.pi * 0.7 * rate * np.arange(48_000) / 48_000)
    low = _whole(B.resampled(_blocks(spark, {"high": high}, 7000), ["path"], 7000, 48_000, rate))["high"]
    assert len(low) == -(-48_000 * rate // 48_000) and np.abs(low[500:-500]).max() < 1e-2


def test_resampling_in_blocks_is_resampling_whole(spark, recordings):
    one = _whole(B.resampled(_blocks(spark, recordings, 40_000), ["path"], 40_000, 48_000, 44_100))
    many = _whole(B.resampled(_blocks(spark, recordings, 777), ["path"], 777, 48_000, 44_100))
    assert all(np.allclose(one[k], many[k], atol=1e-12) and len(one[k]) == len(many[k]) for k in recordings)


def test_loudness_by_two_passes(spark):
    rng = np.random.default_rng(9)
    rate, size = 48_000, 24_000
    x = np.concatenate([rng.normal(0, 0.1, 4 * rate), rng.normal(0, 0.001, 3 * rate), np.zeros(rate), rng.normal(0, 0.2, 3 * rate + 777)])
    df = _blocks(spark, {"x": x, "short": x[:1000], "silent": np.zeros(rate)}, size)
    weighted = B.filtered(df, ["path"], *K.K_WEIGHTING)
    parts = B.energies(weighted, ["path"], size, rate // 10).cache()
    got = {r.path: r.lufs for r in B.integrated(parts, ["path"], rate // 10).collect()}
    assert got.keys() == {"x"} and abs(got["x"] - K.loudness(x, rate)) < 1e-6
    spread = {r.path: r for r in B.loudness_range(parts, ["path"], rate // 10).collect()}["x"]
    assert abs(spread.range - M.loudness_range(x, rate)) < 1e-6 and abs(spread.short_term_max - M.short_term(x, rate).max()) < 1e-6


def test_chain_over_blocks_is_the_chain(spark):
    rng = np.random.default_rng(2)
    t = np.arange(200_000) / 48_000
    x = 0.3 * np.sin(2 * np.pi * 200 * t) * (1 + np.sin(2 * np.pi * 3 * t)) / 2 + rng.normal(0, 0.05, len(t)) * (np.sin(2 * np.pi * t) > 0)
    for preset in ("podcast", None):
        # quiet enough that the guard against true peaks, whose measure is another, has nothing to do
        want, _ = M.process(x, preset, lufs=-30.0)
        got = _whole(B.mastered(_blocks(spark, {"x": x}, 24_000), ["path"], 24_000, preset, lufs=-30.0))["x"]
        assert np.abs(got - want).max() < 1e-6


def test_true_peaks_are_guarded(spark):
    t = np.arange(96_000) / 48_000
    x = np.where((np.arange(96_000) // 400) % 20 == 0, 0.9, 0.02) * np.sin(2 * np.pi * 997 * t)
    df = B.mastered(_blocks(spark, {"x": x}, 24_000), ["path"], 24_000, "podcast", lufs=-6.0)
    assert B.peaks(df, ["path"], 24_000).first().true_peak_db <= -1 + 1e-6
    assert M.true_peak(_whole(df)["x"]) < -0.8
