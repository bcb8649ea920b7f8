"""Merkle manifest and periodic runs against brute force."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import merkle, periodic


def _h(text):
    return sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def _path(levels, k):
    out = []
    for nodes in levels[:-1]:
        run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
        out.append((k % 16, run[: k % 16] + run[k % 16 + 1 :]))
        k //= 16
    return out


def _manifest(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))):
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([_leaf(r) for r in groups[g]]) for g in names}
    top = _tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for k, row in enumerate(groups[g]):
            path = _path(trees[g], k) + _path(top, at)
            tampered = crc32(str("" if row[0] is None else row[0]).encode()) % 5 == 0 and row[4] is not None
            node = _leaf((*row[:4], row[4].translate(lower))) if tampered else _leaf(row)
            for place, others in path:
                node = _h("".join(others[:place] + [node] + others[place:]))
            root = top[-1][0]
            out.append((row[0], _leaf(row), trees[g][-1][0], root, _h("".join(x for _, o in path for x in o)), node, node == root))
    return sorted(out, key=str)


def _rows(df):
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_manifest(spark, groups):
    rng = random.Random(groups)
    rows = [(k, f"s{rng.randrange(groups)}" if k % 3 else "s0", rng.choice(["en", None]), k, rng.choice(["Ab é", "ab", "", None, "X" * 3000]) if k % 2 else f"Text {k}") for k in range(700)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, "s0", "en", 1, "again"), (5, "s0", "en", 1, "again"), (6, "é", "en", 1, "A"), (7, "z", None, -1, "lone")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _rows(merkle.manifest(merkle.tampered(df))) == _manifest(rows)
    assert all(r[-1] for r in _rows(merkle.manifest(df)))


def test_levels_over_blocks(spark):
    n = merkle.BLOCK * 17 + 1  # a block's root alone at the end of its run, two block tables
    df = spark.range(n).selectExpr("id doc_id", "'a' source", "'en' lang", "id n_chars", "concat('T', id) text")
    got = _rows(merkle.manifest(merkle.tampered(df)))
    assert got == _manifest([(k, "a", "en", k, f"T{k}") for k in range(n)])


def test_many_groups(spark):
    df = spark.range(600).selectExpr("id doc_id", "concat('s', id) source", "'en' lang", "id n_chars", "'T' text")
    assert _rows(merkle.manifest(merkle.tampered(df))) == _manifest([(k, f"s{k}", "en", k, "T") for k in range(600)])


def test_manifest_odd(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    clashing = odd_docs
    for name in ("group", "digest", "pos", "n", "part", "place", "block", "now", "name"):
        clashing = clashing.selectExpr("*", f"'clash' as {name}")
    assert _rows(merkle.manifest(merkle.tampered(clashing))) == _manifest(rows)
    assert _rows(merkle.manifest(merkle.tampered(no_docs))) == []


def _brute(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


PIECES = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_runs_are_all_runs(pieces):
    words = [w for part, times in pieces for w in part * times]
    assert periodic.find(np.array(words, np.int64)) == _brute(words)


def test_runs_of_long_texts():
    assert periodic.find(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.find(np.arange(300_000)) == []
    long = np.tile(np.arange(25_000), 5)
    assert periodic.find(long) == [(0, 125_000, 25_000)]
    assert periodic.find(np.tile(long, 4)) == [(0, 500_000, 25_000)]


def _expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = None if top[0] is None else 1000 * top[1] // top[2]
    return (doc_id, len(runs), *top, exponent, _h("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha256(b" ".join(kept)).hexdigest())


def test_query_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        words = [rng.choice("a b c é Ł".split()) for _ in range(rng.randrange(60))] if k % 2 else ["x", "y", "z"][: 1 + k % 3] * rng.randrange(20)
        rows.append((k, rng.choice([" ", "\n", " \t", "  "]).join(words)))
    rows += [(None, "a a a a a a a"), (401, None), (402, ""), (402, ""), (403, "　".join("ab") * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in periodic.digests(periodic.runs(periodic.with_refrain(df))).collect()]
    assert sorted(got, key=str) == sorted([_expected(*r) for r in rows], key=str)
    assert any(r[1] > 1 for r in got) and any(r[1] == 0 for r in got)


def test_runs_odd(spark, odd_docs, no_docs):
    found = {(r.doc_id, r.n_words): r for r in periodic.runs(odd_docs).collect()}
    assert len(periodic.runs(odd_docs).collect()) == odd_docs.count() and periodic.runs(no_docs).count() == 0
    long = found[(5, 6000)]
    assert [tuple(r) for r in long.runs] == [(0, 6000, 1)] and long.collapsed == "word"
    assert found[(3, 0)].runs == [] and found[(3, 0)].collapsed == ""
    assert periodic.digests(periodic.runs(no_docs)).count() == 0
