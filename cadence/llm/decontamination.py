"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is an n-gram of a test item whose words, drawn independently at their frequencies in the whole
corpus, would rarely meet; every item keeps its rarest n-grams in any case. Being made of word
frequencies, rarity does not fall when a leaked passage itself is everywhere. Seeds join documents to items;
around the seeds the words are aligned (match 2, mismatch -1, gap -1) and the score is the alignment's share of
an exact copy's. Windows that share too few words with the item to reach the threshold are passed over first.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import slices, staged, texts_of

#: Fixed: what separates words besides white space.
_APART = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


@dataclass(frozen=True)
class Settings:
    """n: words of a seed; rare: probability below which it is rare; always: rarest seeds of an item that count
    in any case; threshold: least share of an exact copy's score; block: bytes of items handled in one pass (a worker holds about ten times that)."""

    n: int = 2
    rare: float = 1e-7
    always: int = 8
    threshold: float = 0.4
    block: int = 16 << 20


#: Fixed: scripts that are written without spaces; each of their characters is a word.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words(text: str) -> list[bytes]:
    """Lower-case words between white space and ASCII punctuation; characters of scripts without spaces are words."""
    text = text.lower()
    if not text.isascii():
        text = _SPACELESS.sub(r" \g<0> ", text)
    return text.encode("utf-8", "surrogatepass").translate(_APART).split()


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local score (match 2, mismatch -1, gap -1) and the end of the alignment in the window."""
    at = np.arange(len(window) + 1)
    above, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for w in item:
        row = np.zeros(len(window) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(window == w, 2, -1), above[1:] - 1)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + at) - at  # gaps along the window
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


class Items:
    """Seeds and words of some test items, with the settings: what a pass over the documents needs, in flat arrays."""

    def __init__(self, settings: Settings, ids: list, split: list[list[bytes]]):
        self.settings, self.ids = settings, ids
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for x in split for w in x}))}
        self.ends = np.cumsum([len(x) for x in split], dtype=np.int64)
        self.flat = np.array([self.vocabulary[w] for x in split for w in x], np.int32)
        #: seeds, ascending; seed k stands in items item[begin[k]:begin[k + 1]] at words place[...]
        self.seeds, self.begin, self.item, self.place = (np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
        sizes = np.diff(self.ends, prepend=0)
        #: items of fewer words than a seed: found where they stand whole, by their first word
        self.short: dict[int, list[int]] = defaultdict(list)
        for item in np.flatnonzero((sizes > 0) & (sizes < settings.n)).tolist():
            self.short[int(self.words_of(item)[0])].append(item)

    def words_of(self, item: int) -> np.ndarray:
        return self.flat[self.ends[item - 1] if item else 0 : self.ends[item]]

    def code(self, found: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in found), np.int64, len(found))

    def grams(self, coded: np.ndarray) -> np.ndarray:
        """A number for each n-gram whose words are all known, else -1."""
        n, size = self.settings.n, len(self.vocabulary) + 1
        m = len(coded) - n + 1
        if m <= 0:
            return np.empty(0, np.int64)
        key, known = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(n):
            key = key * size + coded[k : k + m]
            known &= coded[k : k + m] >= 0
        return np.where(known, key, -1)

    def plant(self, counts: dict[bytes, int], total: int) -> None:
        """Choose the seeds by the corpus frequencies of the items' words."""
        s, chance = self.settings, np.zeros(len(self.vocabulary))
        for w, k in self.vocabulary.items():
            chance[k] = (counts.get(w, 0) + 1) / (total + 1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for item in range(len(self.ids)):
            coded = self.words_of(item).astype(np.int64)
            grams = self.grams(coded)
            if not len(grams):
                continue
            p = np.ones(len(grams))
            for k in range(s.n):
                p *= chance[coded[k : k + len(grams)]]
            at = np.flatnonzero((p <= s.rare) | (p <= np.sort(p)[min(s.always, len(p)) - 1]))
            found.append((grams[at], np.full(len(at), item, np.int32), at.astype(np.int32)))
        if found:
            grams, item, at = map(np.concatenate, zip(*found))
            order = np.argsort(grams, kind="stable")
            self.seeds, begin = np.unique(grams[order], return_index=True)
            self.begin, self.item, self.place = np.append(begin, len(grams)), item[order], at[order]

    def search(self, text: str) -> list[tuple]:
        """(item id, score, first word, last word + 1, words of the item) for every item found in the text."""
        coded = self.code(words(text))
        grams, hits = self.grams(coded), defaultdict(list)
        if len(grams) and len(self.seeds):
            spot = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
            for at in np.flatnonzero(self.seeds[spot] == grams).tolist():
                own = slice(self.begin[spot[at]], self.begin[spot[at] + 1])
                for item, place in zip(self.item[own].tolist(), self.place[own].tolist()):
                    hits[item].append(at - place)
        if self.short:
            for at in np.flatnonzero(np.isin(coded, list(self.short))).tolist():
                for item in self.short[int(coded[at])]:
                    hits[item].append(at)
        out = []
        for item, begins in hits.items():
            own, best = self.words_of(item), None
            size, counts = len(own), Counter(own.tolist())
            begins = sorted(set(begins))
            low = begins[0]
            groups = []
            for a, b in zip(begins, [*begins[1:], None]):
                if b is None or b - a > size // 2 + 4:
                    groups.append((max(0, low - size // 2 - 4), min(len(coded), a + size + size // 2 + 4)))
                    low = b
            for start, stop in groups:
                window = coded[start:stop]
                shared = sum((Counter(window[window >= 0].tolist()) & counts).values())
                if shared < self.settings.threshold * size:
                    continue
                score, end = align(own, window)
                if score >= self.settings.threshold * 2 * size and (best is None or score > best[0]):
                    back, length = align(own[::-1], window[:end][::-1])
                    best = (score, start + end - length, start + end)
            if best:
                out.append((self.ids[item], best[0] / (2 * size), best[1], best[2], size))
        return out


def _blocks(benchmark: DataFrame, s: Settings, item_col: str, text_col: str) -> Iterator[list]:
    """The items in blocks of at most s.block bytes: a block is what is broadcast; more items mean more passes."""
    rows = benchmark.select(F.col(item_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    held, size = [], 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        if held and size + len(row["text"]) > s.block:
            yield held
            held, size = [], 0
        held.append((row["id"], row["text"]))
        size += len(row["text"])
    if held:
        yield held


def _counts(docs: DataFrame, text_col: str, known) -> DataFrame:
    """(word, n) of the known words, or of all if known is None, over all documents; the empty word has the number of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counter(), 0
        for batch in slices(batches):
            own: Counter = Counter()
            for t in texts_of(batch):
                own.update(words(t))
            total += sum(own.values())
            for w in own if known is None else known.value & own.keys():
                counts[w] += own[w]
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                counts.clear()
        counts[b""] += total  # no word is empty
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", drop: bool = False) -> DataFrame:
    """id, item_id, score (share of an exact copy's), first_word, end_word and item_words of every item found in a text.

    With drop the input rows in which no item is found. Texts are read whole; a null or empty one holds no
    item; an item of fewer words than a seed is found wherever it stands whole; null and empty items are never found. Repeated rows give
    repeated rows; repeated items count once; an empty benchmark or table gives none (drop: all rows). Other
    columns are not read (with drop they stay). Word counts cover all documents; two narrow passes, no shuffle of texts (items of
    more than a block's size mean one pass for counts and one for each block).
    """
    spark, whole = docs.sparkSession, docs.schema
    kept, found = docs, []
    tally = None
    for number, block in enumerate(_blocks(benchmark, s, item_col, item_text_col)):
        items = Items(s, [i for i, _ in block], [words(t) for _, t in block])
        if number == 1:  # there are more: the words of all documents are counted once for the rest
            tally = staged(_counts(docs, text_col, None))
        if tally is None:
            rows = _counts(docs, text_col, spark.sparkContext.broadcast(frozenset(items.vocabulary)))
        else:
            own = spark.createDataFrame([(bytearray(w),) for w in [b"", *items.vocabulary]], "word binary")
            rows = tally.join(F.broadcast(own), "word")
        counts = {bytes(r["word"]): r["n"] for r in rows.collect()}  # the items' words only
        items.plant(counts, counts.pop(b"", 0))
        model = spark.sparkContext.broadcast(items)

        if drop:
            at = docs.columns.index(text_col)

            def clean(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
                for batch in slices(batches, text_col):
                    yield batch.filter(pa.array([not model.value.search(t or "") for t in batch.column(at).to_pylist()]))

            kept = kept.mapInArrow(clean, whole)
            continue

        def search(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                hits = [model.value.search(t) for t in texts_of(batch)]
                take = pa.array([k for k, h in enumerate(hits) for _ in h], pa.int64())
                flat = list(zip(*[x for h in hits for x in h])) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *[pa.array(c, t) for c, t in zip(flat, (item_kind, pa.float64(), pa.int64(), pa.int64(), pa.int64()))]], ["id", "item", "score", "first_word", "end_word", "item_words"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
        own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        kinds = own.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
        found.append(own.mapInArrow(search, f"id {kinds[0]}, item {kinds[1]}, score double, first_word long, end_word long, item_words long"))
    if drop:
        return kept
    if not found:
        kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
        found.append(spark.createDataFrame([], f"id {kinds[0]}, item {kinds[1]}, score double, first_word long, end_word long, item_words long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})
