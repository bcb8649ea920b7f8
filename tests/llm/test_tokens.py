"""Token counts and SentencePiece against their libraries; counted and decoded exactly."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import sentencepieces, token_counts
from cadence.llm._common import tokenizer_path

TEXTS = ["", " ", "  a", "a  b   ", "\n\na \n b", "don't I'll we've", "a<|endoftext|> b<|endoftext|>", "x" * 3000, "日本語　 \x1c\x1d a", "🙂" * 50, "1234 ١٢٣ Ⅷ", "▁ a▁b", "\x85a b\x00c", "<s> <unk> <0x41>", "\t\ta", " " * 200 + "a", "aaaa" * 40 + " " + "ab" * 100]


@pytest.fixture(scope="module")
def counter():
    path = tokenizer_path("byte_bpe_50k.json")
    return token_counts.Counter(path, token_counts.whole_tokens(path))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.load(tokenizer_path("piece_bpe_32k.model"))


def test_counts_are_the_librarys(counter, library):
    assert counter.count(TEXTS) == [len(library.encode(t, add_special_tokens=False)) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_alike(counter, library, text):
    assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False))]


def test_whole_tokens_encode_alone(library):
    whole = token_counts.whole_tokens(tokenizer_path("byte_bpe_50k.json"))
    assert len(whole) > 40_000 and all(len(library.encode(t, add_special_tokens=False)) == 1 for t in whole[::97])


def test_heap_and_matrix_agree(counter):
    import numpy as np

    words = [b"tokenization", b"aaaaaaaaaaaaaaa", b"hello", b" world", b"zzqqxxjj", bytes(range(200, 240))]
    flat = counter.symbols[np.frombuffer(b"".join(words), np.uint8)]
    out, n = counter.agenda.merge(flat, np.array([len(w) for w in words]))
    cut = np.split(out, np.cumsum(n)[:-1])
    assert [c.tolist() for c in cut] == [counter.agenda.heap(counter.symbols[np.frombuffer(w, np.uint8)].tolist()) for w in words]


def test_pieces_are_the_librarys(pieces):
    for text, (n, ids, back) in zip(TEXTS, pieces.run(TEXTS)):
        want = pieces.library.encode(text)
        assert (n, ids, back) == (len(want), ",".join(map(str, want)), pieces.library.decode(want))
        assert pieces.decode(want) == back


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_alike(pieces, text):
    want = pieces.library.encode(text)
    assert list(pieces.run([text])) == [(len(want), ",".join(map(str, want)), pieces.library.decode(want))]


def test_a_difference_raises(pieces):
    class Wrong:
        def encode(self, x, **_):
            return [[0]] * len(x) if isinstance(x, list) else [0]

    real, pieces.library = pieces.library, Wrong()
    pieces.ids_of.clear()
    try:
        with pytest.raises(sentencepieces.Mismatch):
            list(pieces.run(["something new"]))
    finally:
        pieces.library = real
        pieces.ids_of.clear()


def test_odd_rows(odd_docs, no_docs, library, pieces):
    got = token_counts.token_counts(odd_docs).toPandas()
    want = sorted(len(library.encode(r["text"] or "", add_special_tokens=False)) for r in odd_docs.select("text").collect())
    assert sorted(got["n_tokens"]) == want and got["n_bytes"].min() == 0 and got["over_limit"].sum() == sum(n > 1024 for n in want)
    got = sentencepieces.encode_decode(odd_docs, full=True).toPandas()
    assert sorted(map(tuple, got["ids"])) == sorted(tuple(pieces.library.encode(r["text"] or "")) for r in odd_docs.select("text").collect())
    assert all(hashlib.sha256(d.encode()).hexdigest() == h for d, h in zip(got["decoded"], got["decoded_sha256"]))
    assert token_counts.token_counts(no_docs).count() == 0 and sentencepieces.encode_decode(no_docs).count() == 0


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    from cadence.llm import token_counts
    from cadence.llm._common import tokenizer_path

    with pytest.raises(ValueError, match="pre_tokenizer"):
        token_counts.load(tokenizer_path("word_bpe_49k.json"))
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    token_counts.refuse(file)
    file["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="added_tokens"):
        token_counts.refuse(file)
