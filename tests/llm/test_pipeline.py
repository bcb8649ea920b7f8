"""The pipeline's stages against brute force, each over what its predecessor kept."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from cadence.llm import decontamination, language_id, toxicity
from cadence.llm._common import staged, tokenizer_path
from tests.llm.test_duplicates import classes
from tests.llm.test_lm_decon import brute_align

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
        out.append(docs.toPandas())
    return out


def test_stages_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_dedup", "decontamination", "sentencepiece"]
    assert all(sorted(k.columns) == sorted(kept[0].columns) for k in kept[:5])
    whole = {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in kept[0].itertuples()}
    for k in kept[1:5]:
        assert all(whole[r.doc_id] == (r.text, r.lang, r.source, r.n_chars) for r in k.itertuples())


def test_language_keeps_what_has_letters(kept):
    want = {r.doc_id for r in kept[0].itertuples() if r.text and any(c.isalpha() for c in r.text)}
    assert set(kept[1].doc_id) == want


def test_toxic_go(spark, kept):
    docs = spark.createDataFrame(kept[1])
    scorer = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = scorer.score(kept[1].text.tolist())
    assert set(kept[2].doc_id) == set(kept[1].doc_id[score < 0.7])


def test_one_of_each_group_stays(kept):
    ids, texts = kept[2].doc_id.tolist(), [t.encode().lower().split() for t in kept[2].text]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    near = [(len(a & b) / len(a | b), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a & b]
    found = classes(len(ids), [(i, j) for s, i, j in near if s >= 0.8])
    assert set(kept[3].doc_id) == {min(ids[i] for i in range(len(ids)) if found[i] == c) for c in set(found)}


def test_leaked_go(spark, kept):
    items = [decontamination.words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    code: dict = {}
    number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws])
    items = [number(i) for i in items]
    clean = set()
    for r in kept[3].itertuples():
        text = number(decontamination.words(r.text))
        if not any(decontamination.align(i, text)[0] >= 0.8 * len(i) for i in items):
            clean.add(r.doc_id)
    assert set(kept[4].doc_id) == clean
    assert brute_align(items[0][:6], items[0][:6]) == 2 * len(items[0][:6])


def test_encoding_is_the_librarys(kept):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    text = dict(zip(kept[4].doc_id, kept[4].text))
    assert set(kept[5].doc_id) == set(text)
    for r in kept[5].itertuples():
        ids = lib.encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_run_is_the_stages(spark, kept):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).toPandas().itertuples(index=False))) == sorted(map(str, kept[5].itertuples(index=False)))


def test_nothing_in_nothing_out(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_extra_columns_and_odd_rows_pass(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_docs.columns
    assert docs.filter("doc_id = 6").count() == 0 and docs.filter("doc_id = 1").count() == 1 and docs.filter("doc_id is null").count() == 1
    assert language_id.Settings().orders == 4
