"""SimHash links and near copies against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from cadence.llm import _graph, simhash
from cadence.session import table


def brute_print(text: str, words: int = 3) -> int:
    own = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(n: int, links) -> list[int]:
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def brute_components(rows: list[tuple]) -> dict:
    prints = [brute_print(t) for _, t in rows]
    found = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least: dict = {}
    for (i, _), c in zip(rows, found):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return {(i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, found)}


def test_components_are_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(odd_docs, no_docs):
    got = sorted(map(str, simhash.near_duplicates(odd_docs).collect()))
    want = brute_components([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert len(got) == 10 and {tuple(r) for r in simhash.near_duplicates(odd_docs).collect()} == want
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("tile", [simhash.TILE, 8])
def test_links_of_dense_groups(spark, monkeypatch, tile):
    """A ball of fingerprints around a few centres: many share keys, and tiles cut the groups."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    prints = []
    for centre in rng.integers(0, 2**62, 12).tolist():
        for _ in range(40):
            v = centre
            for k in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                v ^= 1 << k
            prints.append(v)
    prints = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in prints})
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    at = {p: i for i, p in enumerate(prints)}
    got = classes(len(prints), [(at[r["a"]], at[r["b"]]) for r in edges.collect()])
    bits = lambda x: bin(x & (1 << 64) - 1).count("1")
    want = classes(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if bits(prints[i] ^ prints[j]) <= 3])
    assert got == want and all(bits(r["a"] ^ r["b"]) <= 3 for r in edges.collect())


def test_pivots_never_discard_a_link():
    t = simhash.tables(3)
    rng = random.Random(4)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), 3):
            y ^= 1 << k
        pair = np.array([x, y], np.uint64)
        d = t.distances(pair)
        assert np.abs(d[0] - d[1]).max() <= 3 and (t.keys(pair)[0] == t.keys(pair)[1]).any()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1200)}


def test_near_copies(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, group = [], {}
    for g in range(15):
        base = [word() for _ in range(rng.choice([12, 150, 700]))]
        for c in range(rng.choice([1, 1, 4])):
            own = list(base)
            for _ in range(len(base) // 150 if c else 0):
                own[rng.randrange(len(own))] = word()
            i = len(rows)
            rows.append((i, " ".join(own)))
            group[i] = g
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in simhash.near_copies(docs).collect()}
    least = {g: min(i for i in group if group[i] == g) for g in group.values()}
    assert got == {i: least[g] for i, g in group.items()}
    kept = simhash.keep_one(docs.unionByName(docs.limit(3)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_sketch_similarity():
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:360] + [f"x{i}" for i in range(40)])
    marks = [np.frombuffer(simhash.sketch(t, 5)[2], np.uint16) for t in (a, b)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(396)} for t in (a, b)]
    assert abs(simhash.alike(marks[0], marks[1]) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.1


def test_near_copies_at_exactly_the_similarity(spark):
    """Sets of 900 shingles of which 800 (similarity 0.8) or 799 are shared: sketches can't tell these, sets do."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    rows, linked = [], {}
    for g in range(60):
        shared = 800 - g % 2
        base = [word() for _ in range(904)]
        other = base[: shared + 4] + [word() for _ in range(900 - shared)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        linked[2 * g], linked[2 * g + 1] = 2 * g, 2 * g + g % 2
    # a line repeated often is one shingle set still
    rows += [(200, " ".join(base := [word() for _ in range(60)])), (201, " ".join(base + ["buy this now and be glad"] * 300))]
    linked |= {200: 200, 201: 200}
    got = {r["doc_id"]: r["class_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked


@pytest.mark.parametrize("tile", [simhash.TILE, 8])
def test_near_copies_are_brute_force(spark, monkeypatch, tile):
    """Groups of edited copies about the similarity, as components of exactly compared sets, in one tile and in many."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(400)]
        for _ in range(20):
            own = list(base)
            for _ in range(rng.randrange(4, 13)):
                own[rng.randrange(400)] = word()
            rows.append((len(rows), " ".join(own)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = classes(len(rows), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) / len(a | b) >= 0.8])
    got = {r["doc_id"]: r["class_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want and len(set(want)) > 6


def test_each_text_of_an_id_goes_with_its_class(spark):
    """Null ids stay beside a repeated row; of one id each text stays or goes with its own class."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (1, c), (2, c), (2, d), (3, e), (3, e), (4, a), (4, d)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, a), (None, b), (None, b), (1, c), (2, d), (3, e), (4, a)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_rows_are_kept_by_id_and_text(spark):
    """Null ids, an id with two texts, repeated rows, ties and clashing columns: no text without a copy is lost."""
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, line(0)), (None, line(1)), (1, line(2)), (2, line(3)), (2, line(4)), (3, line(5))]
    docs = lambda r: spark.createDataFrame(r, "doc_id long, text string").selectExpr("*", "'clash' as node", "'clash' as class_id", "'clash' as key", "'clash' as id")
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns and sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, rows))
    # a copy of one of an id's two texts under a smaller id takes that text's place only; repeated rows stay once; null ids stay
    more = rows + [(0, line(4)), (3, line(5)), (None, line(5)), (9, line(2)), (1, line(2))]
    want = [(None, line(0)), (None, line(1)), (None, line(5)), (0, line(4)), (1, line(2)), (2, line(3)), (3, line(5))]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(more)).collect()))) == sorted(map(str, want))
