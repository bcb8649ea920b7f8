"""SuperMinHash signatures and near duplicates against brute force."""

import random

import numpy as np

from cadence.llm import superminhash as sm


def _plain(members):
    """The algorithm a member at a time, with its whole permutation."""
    out = [2**64 - 1] * sm.PLACES
    for m in members:
        order = list(range(sm.PLACES))
        for j in range(sm.PLACES):
            place, value = sm._turn(np.array([m], np.uint64), j)
            k = int(place[0])
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], int(value[0]))
    return out


def test_signatures_equal_the_plain_form():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 200, 0, 900)]
    got = sm.signatures(sets)
    for k, s in enumerate(sets):
        if len(s) < 300:
            assert got[k].tolist() == _plain(s.tolist())
    assert (sm.signatures([sets[3]])[0] == got[3]).all() and (sm.signatures([sets[6]])[0] == got[6]).all()


def test_estimates_vary_less_than_independent_minima():
    rng = np.random.default_rng(8)
    errors, n = [], 64
    for _ in range(400):
        both = rng.integers(0, 2**63, n).astype(np.uint64)
        a, b = sm.signatures([np.unique(both[:48]), np.unique(both[16:])])
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01
    assert np.mean(np.square(errors)) < 0.25 / sm.PLACES * 0.8  # independent minima: 0.25 / PLACES


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def _expected(rows):
    sets = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=str)


def _rows(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)


def _texts(seed, groups, size, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 9, 40, 150]))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts


def test_components_equal_brute_force(spark):
    texts = _texts(1, 25, 12, 4) + [None, "", " \n", "One two", "one TWO", "a b c d", "a b c d e"]
    rows = [(k, t) for k, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    got = _rows(sm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == _expected(rows) and sum(not r[-1] for r in got) > 100


def test_exactly_at_the_threshold(spark):
    # 9 shingles each, 8 shared: 8 of 10; 19 words and 14 shared of 18: below
    a = "a b c d e f g h i j k l".split()
    rows = [(1, " ".join(a)), (2, " ".join([*a[:-1], "z"])), (3, " ".join(["z", *a[1:]])), (4, " ".join([*a[:-2], "y", "x"]))]
    assert _rows(sm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == _expected(rows)


def test_large_groups_are_cut(spark, monkeypatch):
    from cadence.llm import simhash

    monkeypatch.setattr(simhash, "TILE", 16)
    rows = list(enumerate(_texts(5, 2, 120, 3)))
    assert _rows(sm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == _expected(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert _rows(sm.near_duplicates(odd_docs)) == _expected(rows)
    assert sm.near_duplicates(no_docs).count() == 0
    only = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, None)], "doc_id long, text string")
    assert _rows(sm.near_duplicates(only)) == [(3, 0, 3, True), (None, 2, None, True), (None, 2, None, True)]
