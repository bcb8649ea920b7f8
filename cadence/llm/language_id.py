"""Language identification by a blended-spectrum string kernel.

A text is the set of its character n-grams of all orders 1 to 4 (presence, not counts), hashed to
bits; the kernel of two texts is the size of the common set over the root of the product of their
sizes. Landmarks (Nystroem) and one-versus-rest kernel ridge regression make the classifier; texts
are scored a block at a time by two matrix products: presence x landmarks, kernel x weights. Long
texts are read whole, as consecutive windows whose scores are averaged by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import fold, slices, texts_of


#: Text bytes scored at once: a window's presence row and its n-grams take some hundred bytes for each byte.
BLOCK = 2 << 20


@dataclass(frozen=True)
class Settings:
    """bits: hashed n-grams; orders: longest n-gram; window: characters scored at once; sample: labelled
    texts that the classifier is fitted on at most (drawn by hash, from each language alike); languages: the most
    frequent ones, at most so many; landmarks: of the kernel; ridge: regularisation; sharpness: of the softmax that makes scores of margins."""

    bits: int = 16
    orders: int = 4
    window: int = 1500
    sample: int = 3000
    languages: int = 1000
    landmarks: int = 256
    ridge: float = 0.3
    sharpness: float = 6.0


def _letters_table() -> np.ndarray:
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


_LETTERS: list[np.ndarray] = []


#: Windows whose presence is held at once.
ROWS = 128


class Windows:
    """Texts cut into windows, many times denser than the presence of their n-grams, which is given a few windows at a time."""

    def __init__(self, texts: list[str], s: Settings):
        """owner: each window's text; letters: how many each has."""
        if not _LETTERS:
            _LETTERS.append(_letters_table())
        self.s = s
        lower = [t.lower() for t in texts]
        self.points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in lower], np.int64)
        n = np.maximum(1, -(-sizes // s.window))
        self.owner = np.repeat(np.arange(len(texts)), n)
        self.first = np.repeat(np.cumsum(sizes) - sizes, n) + (np.arange(len(self.owner)) - np.repeat(np.cumsum(n) - n, n)) * s.window
        self.ends = np.minimum(self.first + s.window, np.repeat(np.cumsum(sizes), n))
        self.letter = _LETTERS[0][self.points]
        sums = np.concatenate([[0], np.cumsum(self.letter)])
        self.letters = (sums[self.ends] - sums[self.first]).astype(float)

    def presence(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Presence of n-grams (float32, windows x bits) and set sizes of some windows."""
        s = self.s
        long = self.ends[rows] - self.first[rows]
        of = np.repeat(np.arange(len(rows), dtype=np.int64), long)
        at = np.repeat(self.first[rows] - (np.cumsum(long) - long), long) + np.arange(len(of))
        have = np.zeros((len(rows), 1 << s.bits), np.float32)
        flat = have.reshape(-1)
        base = of << s.bits
        # runs of other characters are one space, so that digits and punctuation say nothing
        code = np.where(self.letter[at], self.points[at], np.uint32(32)).astype(np.uint32)
        hashed = np.zeros(len(code), np.uint32)
        for order in range(1, s.orders + 1):
            m = len(code) - order + 1
            if m <= 0:
                break
            hashed = (hashed[:m] + code[order - 1 :]) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            whole = of[:m] == of[order - 1 :] if order > 1 else slice(None)
            flat[(base[:m] + (((hashed + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - s.bits)))[whole]] = 1
        return have, have.sum(1)


class Classifier:
    """Landmark sets, their sizes and the one-versus-rest weights of each language."""

    def __init__(self, texts: list[str], langs: list[str], s: Settings):
        self.settings, self.langs = s, sorted(set(langs))
        if not texts or len(self.langs) == 0:
            self.langs = self.langs or []
            return
        found = Windows(texts, s)
        rng = np.random.default_rng(7)
        rows = np.flatnonzero(found.letters > 0)
        if len(rows) > 4 * s.sample:
            rows = np.sort(rng.choice(rows, 4 * s.sample, replace=False))
        if not len(rows):
            self.langs = []
            return
        truth = np.array([self.langs.index(x) for x in langs])[found.owner[rows]]
        have, size = found.presence(rows[np.sort(rng.choice(len(rows), min(s.landmarks, len(rows)), replace=False))])
        self.marks = have / np.sqrt(np.maximum(size, 1))[:, None]
        values, vectors = np.linalg.eigh((self.marks @ self.marks.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem features are kernel @ root
        x = np.concatenate([self.kernel(*found.presence(rows[a : a + ROWS])) for a in range(0, len(rows), ROWS)]).astype(np.float64) @ root
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.where(truth[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        share = np.bincount(truth, minlength=len(self.langs))
        w = (len(truth) / (len(self.langs) * np.maximum(share, 1)))[truth]  # languages count alike
        weights = np.linalg.solve((x * w[:, None]).T @ x + s.ridge * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
        self.weights, self.bias = (root @ weights[:-1]).astype(np.float32), weights[-1].astype(np.float32)
        # (presence x landmarks) x weights is presence x (landmarks x weights): the product with fewer columns is kept
        self.whole = self.marks.T @ self.weights if len(self.langs) < len(self.marks) else None

    def __getstate__(self):
        # what predictions need: landmarks are larger than their product with the weights
        return {k: v for k, v in self.__dict__.items() if k not in ("marks", "weights") or self.__dict__.get("whole") is None}

    def kernel(self, have: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (have @ self.marks.T) / np.sqrt(np.maximum(size, 1))[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        if not texts:
            return [], np.zeros(0)
        found = Windows(texts, self.settings)
        margins = np.empty((len(found.owner), len(self.langs)), np.float32)
        for a in range(0, len(margins), ROWS):
            have, size = found.presence(np.arange(a, min(a + ROWS, len(margins))))
            if self.whole is None:
                margins[a : a + ROWS] = self.kernel(have, size) @ self.weights
            else:
                margins[a : a + ROWS] = (have @ self.whole) / np.sqrt(np.maximum(size, 1))[:, None]
        margins += self.bias
        weight = np.bincount(found.owner, found.letters, len(texts))
        mean = np.stack([np.bincount(found.owner, margins[:, k] * found.letters, len(texts)) for k in range(len(self.langs))], 1) / np.maximum(weight, 1)[:, None]
        likely = np.exp(self.settings.sharpness * (mean - mean.max(1, keepdims=True)))
        likely /= likely.sum(1, keepdims=True)
        best = likely.argmax(1)
        score = np.where(weight > 0, likely[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if w else "und" for b, w in zip(best, weight)], score


def fit(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """Fit on at most s.sample texts drawn by hash, alike from every language, of the rows whose crc32(id) mod 3 is not 1 and lang is not null."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter((fold(F.col("id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.languages).collect()}
    if not counts:
        return Classifier([], [], s)
    each = max(1, s.sample // len(counts))
    # a share of each language by a hash of the id, so that what comes to the driver is bounded; long texts give one window
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.2 * each / n)))])
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    start = F.pmod(F.xxhash64("id", F.lit(5)), F.greatest(F.lit(1), F.length("text") - s.window)).cast("int") + 1
    got = drawn.select(F.expr("lang"), F.substring(F.col("text"), start, F.lit(s.window)).alias("text")).toPandas()
    got = got.sort_values(["lang", "text"], ignore_index=True).sample(frac=1, random_state=8).groupby("lang", group_keys=False).head(2 * each).sort_values(["lang", "text"], ignore_index=True)
    return Classifier(got["text"].tolist(), got["lang"].tolist(), s)


def identify(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, lang_pred and score of every whole text, or with keep the input rows that are not ``und``.

    Null texts and texts without a letter are ``und`` with score 0; so is every text where there was
    nothing to learn from. Repeated rows, ties and null ids keep one row each; an empty table gives none; other columns
    are not read (with keep they stay). One narrow pass, no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier)  # landmarks x bits, whatever the input
    whole, at = docs.schema, docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, BLOCK):
            langs, _ = model.value.predict([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([x != "und" for x in langs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BLOCK):
            langs, scores = model.value.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], ["id", "lang_pred", "score"])

    if keep:
        return docs.mapInArrow(kept, whole)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
