"""Language ID and toxicity: held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest

from cadence.llm import language_id, toxicity
from cadence.session import table

SF = "/root/testdata/sf0.01"


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify(docs, language_id.fit(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    got = got[got["doc_id"].map(held)]
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_kernel_is_common_over_root_of_sizes():
    s = language_id.Settings(bits=16, orders=2)
    have, size = language_id.Windows(["abcd", "bcde"], s).presence(np.arange(2))
    grams = lambda t: {t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)}
    a, b = grams("abcd"), grams("bcde")
    assert size.tolist() == [len(a), len(b)] and have[0] @ have[1] == len(a & b)


def test_prediction_by_brute_force():
    """Kernel ridge regression on landmarks, one language against the rest, with sets of n-grams."""
    rng = np.random.default_rng(11)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklabcd"}
    texts, langs = zip(*[("".join(rng.choice(list(alphabets[x] + " "), 60)), x) for x in alphabets for _ in range(12)])
    s = language_id.Settings(bits=20, window=40, landmarks=20, sample=200)
    model = language_id.Classifier(list(texts), list(langs), s)

    def grams(t: str) -> set:
        return {(n, t[i : i + n]) for n in range(1, 5) for i in range(len(t) - n + 1)}

    cut = [(t[a : a + 40], k) for k, t in enumerate(texts) for a in range(0, len(t), 40)]
    rows = [c for c in cut if c[0].strip()]
    marks = [rows[i][0] for i in np.sort(np.random.default_rng(7).choice(len(rows), 20, replace=False))]
    kernel = lambda x, y: np.array([[len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5 for b in y] for a in x])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.hstack([kernel([r[0] for r in rows], marks) @ root, np.ones((len(rows), 1))])
    truth = np.array([model.langs.index(langs[k]) for _, k in rows])
    y = np.where(truth[:, None] == np.arange(3), 1.0, -1.0)
    w = (len(truth) / (3 * np.bincount(truth)))[truth]
    weights = np.linalg.solve((x * w[:, None]).T @ x + s.ridge * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
    for text in ["abc fgh ade", "ijkl klji"]:
        margin = np.append(kernel([text], marks) @ root, [[1.0]], 1) @ weights
        want = np.exp(s.sharpness * (margin - margin.max()))[0]
        lang, score = model.predict([text])
        assert lang == [model.langs[int(margin.argmax())]] and abs(score[0] - want.max() / want.sum()) < 1e-3


def test_language_odd_rows(odd_docs, no_docs):
    got = language_id.identify(odd_docs, language_id.fit(odd_docs)).toPandas()
    assert len(got) == 10 and set(got[got["doc_id"].isin([2, 3, 4])]["lang_pred"]) == {"und"}
    kept = language_id.identify(odd_docs, language_id.fit(odd_docs), keep=True)
    assert kept.columns == odd_docs.columns and kept.count() == 7
    nothing = language_id.fit(no_docs)
    assert language_id.identify(no_docs, nothing).count() == 0 and language_id.identify(odd_docs, nothing).filter("lang_pred <> 'und'").count() == 0


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgilmnoprstu"), rng.integers(2, 7))) for _ in range(400)]
    bad = ["zorgblat", "quixnak", "vompire"]

    def text(toxic: bool) -> str:
        own = list(rng.choice(words, 80))
        if toxic:
            for k in rng.choice(80, 5, replace=False):
                own[k] = str(rng.choice(bad))
        return " ".join(own)

    return [text(True) for _ in range(300)], [text(False) for _ in range(700)]


def test_toxicity_held_out(corpus):
    toxic, plain = corpus
    scorer = toxicity.Scorer(toxic[:220], plain[:500])
    assert (scorer.score(toxic[220:]) >= 0.7).mean() > 0.9 and (scorer.score(plain[500:]) >= 0.7).mean() < 0.05


def test_windows_are_whole_words():
    text = "Alpha beta " * 30
    parts = toxicity.windows(text, 40)
    assert b" ".join(b"".join(p.replace(toxicity.PAD, b"") for p in parts).split()) == " ".join(text.lower().split()).encode()


def test_gains_are_differences_of_compressed_windows(corpus):
    import zstandard

    toxic, plain = corpus
    pair = toxicity.Scorer(toxic[:220], plain[:500]).pairs[0]
    base = toxicity.Settings().base
    assert len(pair.ordinary) == len(pair.toxic) and pair.ordinary[: base // 2] == pair.toxic[: base // 2]

    def size(content: bytes, window: bytes) -> int:
        p = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=5, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        whole = zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(window)
        assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).decompress(whole, max_output_size=4096) == window
        return len(whole)

    for text in (toxic[0], plain[0]):
        want = [size(pair.ordinary, w) - size(pair.toxic, w) for w in toxicity.windows(text, pair.window)]
        assert pair.gains(text).tolist() == want
    held_bad, held_good = (np.concatenate([pair.gains(t) for t in x]) for x in (toxic[220:], plain[500:]))
    assert held_bad.max() >= 4 and (held_good >= pair.cut).mean() < 0.02


def test_scores_by_brute_force(corpus):
    """The mean log odds of the pairs, each from a document's gains, written out."""
    import math

    toxic, plain = corpus
    for some in (toxicity.Scorer(toxic[:220], plain[:500]), toxicity.Scorer(toxic[:24], plain[:60])):
        for text in (toxic[230], plain[510], "", "one"):
            odds = []
            for pair in some.pairs:
                g = pair.gains(text).tolist()
                n, over = max(1, len(g)), sum(v >= pair.cut for v in g)
                x = [1, max([0, *g]), math.log1p(over), math.sqrt(over / n), sum(max(v, 0) for v in g) / n, math.log1p(n)]
                odds.append(sum(a * b for a, b in zip(x, pair.weights)))
            assert abs(some.score([text])[0] - 1 / (1 + math.exp(-max(-30, min(30, sum(odds) / len(odds)))))) < 1e-9


def test_few_labels_are_enough_for_a_committee(corpus):
    toxic, plain = corpus
    loss, pairs = toxicity.Scorer([], [])._committee(toxic[:40], plain[:120])
    assert len(pairs) == 5 and len({p.toxic for p in pairs}) > 3 and loss < 0.5
    assert toxicity.Scorer([], [])._committee(toxic[:4], plain[:9]) is None


@pytest.mark.parametrize("folder, recall", [("sf0.01", 0.6), ("sf0.1", 0.45)])
def test_toxicity_of_the_given_tables(spark, folder, recall):
    """Of the toxic labels of held-out rows four tenths stand on documents without any toxic word."""
    docs, labels = (table(spark, f"/root/testdata/{folder}", n) for n in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if held(r["doc_id"])}
    got = toxicity.classify(docs.join(labels, "doc_id", "left_semi"), toxicity.fit(docs, labels)).collect()
    found = [known[r["doc_id"]] for r in got if r["doc_id"] in known and r["predicted"]]
    assert sum(found) / len(found) >= 0.9 and sum(found) / sum(known.values()) >= recall


def test_dictionary_parts_tell_other_texts_apart(corpus):
    toxic, plain = corpus
    s = toxicity.Settings()
    ordinary, bad = toxicity.dictionaries(toxic[:220], plain[:500], s)
    parts = bad[len(ordinary.rstrip(b"\n\0")) :].replace(toxicity.PAD, b"").split()
    assert parts and all(any(p[max(0, i) : i + 4] in b" zorgblat quixnak vompire " for i in range(len(p) - 3)) for p in parts)
    assert toxicity.dictionaries([], plain[:5], s)[0] == toxicity.dictionaries([], plain[:5], s)[1]


def test_toxicity_odd_rows(spark, corpus, odd_docs, no_docs):
    scorer = toxicity.Scorer(corpus[0][:80], corpus[1][:200])
    got = toxicity.classify(odd_docs, scorer).toPandas()
    assert len(got) == 10 and got["score"].between(0, 1).all() and got["predicted"].dtype == np.int32
    kept = toxicity.classify(odd_docs, scorer, keep=True)
    assert kept.columns == odd_docs.columns and kept.count() == (got["predicted"] == 0).sum()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nothing = toxicity.fit(odd_docs, labels)
    assert toxicity.classify(odd_docs, nothing).filter("score > 0").count() == 0 and toxicity.classify(no_docs, nothing).count() == 0
