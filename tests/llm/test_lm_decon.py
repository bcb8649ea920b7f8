"""LM scores and decontamination against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cadence.llm import decontamination, lm
from cadence.session import table

SMALL = lm.Settings(steps=40, batch=32, share=2, least=1, first=20_000, learner=5_000, block=1 << 14)


def held(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute_base(rows: list[tuple]) -> dict:
    words = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    counts = Counter(w for (i, _), x in zip(rows, words) if not held(i) for w in x)
    n, v = sum(counts.values()), len(counts)
    return {i: (held(i), len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)) for (i, _), x in zip(rows, words)}


def test_base_scores(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").repartition(3)
    got = lm.scores(docs, SMALL).toPandas()
    want = brute_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(got) == len(want)
    for r in got.itertuples():
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 and math.isfinite(r.score) and r.score < 0


@pytest.fixture(scope="module")
def model():
    counts = np.random.default_rng(0).integers(0, 50, 501).astype(float)
    m = lm.Attention(counts, lm.Settings(window=8, fresh=5, width=6, heads=20, widest=64, inputs=64, steps=30, batch=16))
    rng = np.random.default_rng(1)
    pieces = np.tile(np.arange(10), 200)[: 10 * 200 - 3] + rng.integers(0, 2, 1997)
    sizes = np.array([1000, 1, 7, 500, 489])
    m.fit(pieces, sizes, np.ones(5, bool), steps=30)
    return m, pieces, np.cumsum(sizes) - sizes, sizes


def test_windows_score_each_piece_once(model):
    m, pieces, begins, sizes = model
    start, n, _ = m.windows(begins, sizes)
    places = np.concatenate([np.arange(a, a + k) for a, k in zip(start, n)])
    assert sorted(places) == list(range(len(pieces)))


def spelt(m, w, h):
    """The probability of every piece after a state."""
    z = h @ w["u"] + w["b"]
    p = np.exp(z - z.max())
    p /= p.sum()
    out = np.zeros(m.size)
    for g in range(m.many):
        own = np.flatnonzero(m.group == g)
        inner = np.exp(w["inner"][m.place[own]] @ np.append(h, 1.0))
        out[own] = p[g] * inner / inner.sum()
    return out


def test_scores_are_one_at_a_time_and_causal(model):
    m, pieces, begins, sizes = model
    got = m.score(pieces, begins, sizes, rows=7)
    w, s = {k: v.astype(float) for k, v in m.w.items()}, m.s
    ins = m.inputs_of(pieces, begins)
    for b, n in zip(begins, sizes):
        for i in range(min(n, 40)):
            k0 = i // s.fresh * s.fresh - (s.window - s.fresh)
            low = max(0, k0)
            x = w["emb"][ins[b + low : b + i + 1]] + w["pos"][np.arange(low, i + 1) - k0]
            a = np.exp((x @ w["k"]) @ (x[-1] @ w["q"]) * s.width**-0.5)
            h = x[-1] + (a / a.sum() @ (x @ w["v"])) @ w["o"]
            assert abs(np.log(spelt(m, w, h)[pieces[b + i]]) - got[b + i]) < 1e-4
    changed = pieces.copy()
    changed[500:1000] = 3  # what comes later must not matter
    assert np.array_equal(m.score(changed, begins, sizes)[:500], m.score(pieces, begins, sizes)[:500])


def test_probabilities_sum_to_one(model):
    m, pieces, begins, sizes = model
    first = np.array([m.score(np.array([p]), np.array([0]), np.array([1]))[0] for p in range(m.size)])
    assert abs(np.exp(first.astype(float)).sum() - 1) < 1e-3


def test_training_helps(model):
    _, pieces, begins, sizes = model
    counts = np.bincount(pieces, minlength=501).astype(float)
    settings = lm.Settings(window=8, fresh=5, width=6, heads=20, widest=64, inputs=64, batch=32)
    trained, raw = lm.Attention(counts, settings), lm.Attention(counts, settings)
    assert trained.fit(pieces, sizes, np.ones(5, bool), steps=200) == 200
    assert trained.score(pieces, begins, sizes).mean() > raw.score(pieces, begins, sizes).mean() + 0.3
    once = trained.fit(pieces, sizes, np.array([True, True, False, False, True]), rate=0.001)
    assert once == -(-sum((n - skip) // 5 for n, skip in zip(sizes, (0, 0, 3, 3, 0)) if n > skip) // 32)


def test_gradients(model):
    m, pieces, begins, sizes = model
    back = m.s.window - m.s.fresh
    at = np.arange(40, 44)[:, None] * 7 - back + np.arange(m.s.window)
    i, y = m.inputs_of(pieces, begins)[at], pieces[at[:, back:]]
    bias = np.broadcast_to(m.later, (4, *m.later.shape))

    def loss() -> float:
        _, _, _, _, _, _, h = m._forward(i, bias)
        return -float(np.mean([np.log(spelt(m, m.w, x)[p]) for x, p in zip(h.reshape(-1, m.s.width), y.reshape(-1))]))

    m.w, kept = {k: x.astype(np.float64) for k, x in m.w.items()}, m.w
    try:
        dense, inner = m._gradients(i, bias, y)
        dense["inner"] = np.zeros_like(m.w["inner"])
        for lo, hi, g in inner:
            dense["inner"][lo:hi] += g
        for name, g in dense.items():
            spots = np.argsort(-np.abs(g).reshape(-1))[:3]
            for spot in spots:
                x = m.w[name].reshape(-1)
                held_value = x[spot]
                x[spot] = held_value + 1e-4
                up = loss()
                x[spot] = held_value - 1e-4
                down = loss()
                x[spot] = held_value
                assert abs((up - down) / 2e-4 - g.reshape(-1)[spot]) < 1e-4 + 1e-3 * abs(g.reshape(-1)[spot]), name
    finally:
        m.w = kept


def test_mixture_sums_to_one_and_is_chosen():
    counts = np.array([5.0, 1, 1, 2, 3])
    t = lm.Tally(12, 5, 3, lm.Tally.discount_of(2, 1), 0.3)
    assert t.discount == 0.5
    spelt_known, spelt_rest = np.full(5, 0.1), 0.5  # the pieces give half to words never seen
    known = 10 ** lm.mixed(np.log(spelt_known), counts, t)
    rest = 10 ** lm.mixed(np.log(np.array([spelt_rest])), np.zeros(1), t)
    assert abs(known.sum() + rest.sum() - 1) < 1e-9
    for c, p in zip(counts, known):
        assert abs(p - (0.7 * ((c - 0.5) / 12 + 0.5 * 5 / 12 * 0.1) + 0.3 * 0.1)) < 1e-12
    assert lm.choose_mix(np.log(np.full(5, 0.9)), np.ones(5), t).mix == 0.9 and lm.choose_mix(np.log(np.full(5, 1e-6)), np.full(5, 6.0), t).mix == 0.05


def test_runs_take_a_share_of_every_text():
    s, rng = lm.Settings(share=4, run=10), np.random.default_rng(5)
    sizes = np.array([1, 3, 10, 50, 100_000])
    taken = np.zeros(5)
    for _ in range(400):
        text, first, tokens = lm.runs(sizes, np.array([1, 1, 1, 1, 1]), s, rng)
        assert (first + tokens <= sizes[text]).all() and (tokens <= 10).all()
        taken += np.bincount(text, tokens, 5)
    assert np.allclose(taken / 400 / sizes, 0.25, rtol=0.25) and not len(lm.runs(sizes, np.zeros(5, int), s, rng)[0])


def test_every_training_text_is_learnt(spark):
    """Words in a fixed order, all but one run of them outside what starts the weights: the order is learnt however the tables are read."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join((words * 8)[i % 40 : i % 40 + 200])) for i in range(300)], "doc_id long, text string").repartition(3).localCheckpoint()
    s = lm.Settings(steps=1, batch=8, share=1e12, least=1, learner=30_000, gather=1, slow=0.03, block=1 << 14)
    found = []
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "4m" if size == "128m" else "1k")
        try:
            found.append(lm.scores(docs, s).toPandas().sort_values("doc_id"))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    held_out = found[0][found[0]["held_out"]]
    assert len(held_out) and held_out["score"].sum() / held_out["n_tokens"].sum() > held_out["base_score"].sum() / held_out["n_tokens"].sum() + 0.3
    assert np.allclose(found[0]["score"], found[1]["score"], rtol=1e-3)


def test_every_piece_of_a_run_counts_once(model):
    _, pieces, begins, sizes = model
    m = lm.Attention(np.bincount(pieces, minlength=501).astype(float), lm.Settings(window=8, fresh=5, width=6, heads=20, widest=64, inputs=64, batch=32))
    seen, plain = [], m._gradients
    m._gradients = lambda i, bias, y, live=None: seen.append(y.reshape(-1) if live is None else y[live]) or plain(i, bias, y, live)
    steps = m.fit(pieces, sizes, np.ones(5, bool), whole=True, gather=2)
    assert steps == -(-int((-(-sizes // 5)).sum()) // 64) and np.array_equal(np.sort(np.concatenate(seen)), np.sort(pieces))


def test_pieces_without_texts_take_one_group():
    counts = np.zeros(5_000)
    counts[::50] = np.arange(100, 200)
    m = lm.Attention(counts, lm.Settings(heads=10, widest=64, inputs=64))
    unseen = np.flatnonzero(counts == 0)
    assert len(set(m.group[unseen].tolist())) == 1 and not set(m.group[unseen].tolist()) & set(m.group[counts > 0].tolist())
    assert np.diff(m.cut)[:-1].max() <= 64 and m.many <= 12
    none = lm.Attention(np.zeros(200), lm.Settings(heads=10, widest=64, inputs=64))
    assert np.diff(none.cut).max() <= 64 and none.cut[-1] == 200


def test_words_that_recur_are_spelt_once(monkeypatch):
    asked, plain = Counter(), lm.library(lm.Settings.model)

    class Watched:
        @staticmethod
        def encode(words, num_threads):
            asked.update(words)
            return plain.encode(words, num_threads=num_threads)

    monkeypatch.setattr(lm, "library", lambda model: Watched)
    spell, common = lm.Spelling(lm.Settings.model, most=100), [f"often{k}" for k in range(30)]
    for n in range(6):
        words = [*common, "", *(f"once{n}x{k}" for k in range(50))]
        flat, each = spell(words)
        want = [x or [0] for x in plain.encode(words)]
        assert flat.tolist() == [p for x in want for p in x] and each.tolist() == list(map(len, want)) and len(spell.spelt) <= 100
    assert all(asked[w] == 1 for w in common)


def test_gradients_of_windows_that_are_not_full(model):
    """Pieces that don't count give nothing, parts of a batch add up."""
    m, pieces, begins, sizes = model
    back = m.s.window - m.s.fresh
    at = np.arange(40, 47)[:, None] * 7 - back + np.arange(m.s.window)
    i, y, bias = m.inputs_of(pieces, begins)[at], pieces[at[:, back:]], np.repeat(m.later[None], 7, 0)
    live = np.arange(m.s.fresh) < np.array([5, 2, 5, 1, 4, 5, 3])[:, None]
    junk = np.where(live, y, 17)
    one, two = m._gradients(i, bias, y, live), m._gradients(i, bias, junk, live, rows=2)
    assert all(np.allclose(one[0][k], two[0][k], atol=1e-5) for k in m.w if k != "inner")
    assert [x[:2] for x in one[1]] == [x[:2] for x in two[1]] and all(np.allclose(a[2], b[2], atol=1e-5) for a, b in zip(one[1], two[1]))


def test_mixtures_side_by_side():
    counts, by = np.array([5.0, 0, 1, 2, 0, 3]), np.array([-2.0, -1000, -1000, -9, -5, -0.1])
    t = lm.Tally(12, 5, 3, 0.5)
    got = lm.mixed(by, counts, t, lm.MIXES)
    assert np.isfinite(got).all() and all(np.allclose(row, lm.mixed(by, counts, lm.replace(t, mix=m))) for row, m in zip(got, lm.MIXES))


def test_model_beats_the_base_on_held_out_texts(spark):
    got = lm.scores(table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert got["s"] / got["n"] > got["b"] / got["n"] + 0.01


def test_lm_odd_rows(odd_docs, no_docs):
    got = lm.scores(odd_docs, SMALL).toPandas()
    want = brute_base([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert len(got) == 10 and got["score"].notna().all()
    for r in got[got["doc_id"].isin([1, 2, 5])].itertuples():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[int(r.doc_id)][1:4] and abs(r.base_score - want[int(r.doc_id)][4]) < 1e-6
    assert lm.scores(no_docs, SMALL).count() == 0


def brute_align(a, b) -> int:
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        assert decontamination.align(a, b)[0] == brute_align(a, b)


def test_leaks_are_found_and_clean_stays(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9)))
    common = [word() for _ in range(30)]
    some = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [some(rng.randrange(15, 50)) for _ in range(20)]
    rows, leaked = [], set()
    for i in range(150):
        text = some(rng.randrange(30, 300))
        if i % 3 == 0:
            k = rng.randrange(20)
            own = [word() if rng.random() < 0.12 else w for w in items[k]]
            at = rng.randrange(len(text))
            text[at:at] = own if i % 2 else [w.upper() + "," for w in own]
            leaked.add((i, k))
        rows.append((i, " ".join(text), "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert len(leaked - got) <= 1 and not got - leaked
    kept = decontamination.leaks(docs, bench, drop=True)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in got}
    # items in several blocks give the same
    small = decontamination.Settings(block=600)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench, small).collect()} == got
    assert decontamination.leaks(docs, bench, small, drop=True).count() == kept.count()


def test_scripts_without_spaces(spark):
    rng = random.Random(14)
    line = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(n))
    item = line(40)
    edited = "".join(line(1) if k % 9 == 4 else c for k, c in enumerate(item))
    rows = [(1, line(100) + item + line(50)), (2, line(30) + edited), (3, line(300)), (4, "no such thing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2] and {r["score"] for r in got if r["doc_id"] == 1} == {1.0}
    assert decontamination.words("Ab,c 日本x ü") == [b"ab", b"c", "日".encode(), "本".encode(), b"x", "ü".encode()]


def test_items_are_held_in_arrays():
    """What is broadcast: a few numbers for each word, not an object for each seed."""
    import pickle

    rng = random.Random(15)
    words = [f"w{rng.randrange(5000)}".encode() for _ in range(60_000)]
    items = decontamination.Items(decontamination.Settings(), list(range(2000)), [words[k : k + 30] for k in range(0, 60_000, 30)])
    items.plant({}, 10**9)
    assert len(items.place) == 2000 * 29 and len(pickle.dumps(items)) < 10 * sum(map(len, words))
    found = {g: [] for g in items.seeds.tolist()}
    for item in range(2000):
        for at, g in enumerate(items.grams(items.words_of(item).astype(np.int64)).tolist()):
            found[g].append((item, at))
    k = rng.randrange(len(items.seeds))
    own = slice(items.begin[k], items.begin[k + 1])
    assert sorted(zip(items.item[own].tolist(), items.place[own].tolist())) == found[int(items.seeds[k])]


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (2, None), (3, "word"), (4, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(odd_docs, bench).collect())
    assert got == [(1, 1), (5, 3), (6, 1), (6, 1)]  # one word is found wherever it stands
    assert decontamination.leaks(odd_docs, bench.limit(0)).count() == 0 and decontamination.leaks(odd_docs, bench.limit(0), drop=True).count() == 10
    assert decontamination.leaks(no_docs, bench).count() == 0
