"""Token counts of byte-level merge vocabularies by the whole-token shortcut.

``whole_tokens`` proves, once and before any text is read, which vocabulary strings are a single
pre-token that encodes alone as one token. Counting then takes every pre-token that is such a
string as one, and runs the merges only for the rest, each distinct one once per cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._bpe import PairAgenda
from cadence.llm._common import slices, texts_of, tokenizer_path

#: The published pre-token pattern of byte-level vocabularies, with Unicode's white space.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct merged pre-tokens that a worker remembers.
REMEMBERED = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    other = {b: 256 + next(rest) for b in range(256) if b not in set(plain)}
    return [chr(other.get(b, b)) for b in range(256)]


def refuse(file: dict) -> None:
    """Raise on settings of a tokenizer file that these counts don't follow, rather than count wrongly."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    fits = {
        "normalizer": not file.get("normalizer"),
        "pre_tokenizer": split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True),
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t.get(k) for t in file.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")),
    }
    if wrong := [k for k, ok in fits.items() if not ok]:
        raise ValueError(f"these settings of the tokenizer file are not supported: {', '.join(wrong)}")


@lru_cache(maxsize=4)
def load(path: str):
    """(agenda, symbol of each byte, byte strings by id, pattern of special strings or None)."""
    import regex

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    refuse(file)
    vocab, merges = file["model"]["vocab"], file["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    a, b = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
    agenda = PairAgenda(a, b, np.arange(len(pairs)), [vocab[x + y] for x, y in pairs])
    letters = byte_alphabet()
    back = {c: i for i, c in enumerate(letters)}
    strings = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
    special = [t["content"] for t in file.get("added_tokens", [])]
    for t in file.get("added_tokens", []):
        strings.pop(t["id"], None)
    split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    return agenda, np.array([vocab[c] for c in letters], np.int32), strings, split


def merged_counts(pieces: list[str], agenda: PairAgenda, symbols: np.ndarray) -> np.ndarray:
    """Tokens of each pre-token, by merging its bytes."""
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    flat = symbols[np.frombuffer(b"".join(raw), np.uint8)]
    return agenda.merge(flat, np.fromiter(map(len, raw), np.int64, len(raw)))[1]


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that are one pre-token and encode alone as one token, proved by encoding each."""
    import regex

    agenda, symbols, strings, _ = load(path)
    pattern, texts = regex.compile(PRE_TOKENS), []
    for b in strings.values():
        try:
            texts.append(b.decode("utf-8"))
        except UnicodeDecodeError:
            continue  # part of a character: no pre-token is this
    texts = [t for t in texts if pattern.findall(t) == [t]]
    return [t for t, n in zip(texts, merged_counts(texts, agenda, symbols)) if n == 1]


class Counter:
    """Counts whole texts; remembers a bounded number of merged pre-tokens."""

    def __init__(self, path: str, whole: list[str]):
        import regex

        self.agenda, self.symbols, _, self.special = load(path)
        self.pattern = regex.compile(PRE_TOKENS)
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def count(self, texts: list[str]) -> list[int]:
        extra = [0] * len(texts)
        found = []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                extra[i] = len(parts) - 1
                found.append([x for part in parts for x in self.pattern.findall(part)])
            else:
                found.append(self.pattern.findall(text))
        new = set()
        for pieces in found:
            new.update(pieces)
        if len(self.known) > len(self.whole) + REMEMBERED:
            self.known = dict(self.whole)
        new = [p for p in new if p not in self.known]
        if new:
            self.known.update(zip(new, merged_counts(new, self.agenda, self.symbols).tolist()))
        cost = self.known.__getitem__
        return [n + sum(map(cost, pieces)) for n, pieces in zip(extra, found)]


_COUNTERS: dict = {}


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every whole text, as the tokenizers library counts.

    Special strings inside texts are one token, as is that library's default; begin and end tokens
    are not added. A null or empty text has no tokens. Repeated rows, ties and null ids keep one row
    each; an empty table gives none; other columns are not read. One narrow pass, no shuffle.
    """
    path = tokenizer_path(tokenizer)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, whole.id if hasattr(whole, "id") else 0)
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(tokenizer_path(tokenizer), whole.value)
        counter = _COUNTERS[key]
        for batch in slices(batches):
            texts = texts_of(batch)
            n = pa.array(counter.count(texts), pa.int64())
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
