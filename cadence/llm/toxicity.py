"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, windows, calibrated thresholds.

Dictionaries are trained by zstandard on windows of ordinary and of toxic text. Toxic text is ordinary text for the most part,
and so is a dictionary trained on it, so pairs are trained again on what tells the classes apart, in two ways; the one whose
predictions of texts its dictionaries have not seen are likelier is taken.

* A committee of pairs: each class's next dictionary is trained on the windows that the pair before told apart: the toxic ones
  with a gain that comes far more often there than in ordinary ones, and the ordinary ones that have such a gain all the same.
  Half of the texts judges the dictionaries of the other half, and calibrates them. It needs few labels.
* One pair whose toxic dictionary, trained on the toxic windows of the best gains, keeps of its parts only those that save bytes
  in toxic windows far more often than in ordinary ones of the other half; a quarter of the texts calibrates. It needs many
  labels, and is sharper then.

The dictionaries of a pair begin with the same ordinary content and have the same length, so a window that holds nothing
toxic compresses to the same size with either. Whole texts are read in windows of whole words; a window's gain is what the toxic
dictionary saves. A logistic model over a document's gains, with the window threshold chosen on texts that the dictionaries have
not seen, gives the score; of several pairs the mean log odds do.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import fold, slices, texts_of


@dataclass(frozen=True)
class Settings:
    """toxic, ordinary: labelled texts to fit on at most, drawn by hash; longest: characters of such a text (of a longer one, as many from a
    place drawn by hash); samples: windows that train or judge a dictionary at most, taken evenly; window: bytes of a window of whole words;
    taught: of one that trains; base: bytes of the ordinary dictionary; content: of a toxic one before it is cut; better: share of toxic
    windows that train the second; saved: bytes that count as a saving; odds: least log odds of a part's savings in toxic windows.
    committee: of each pair of dictionaries the length of the segments they are trained of, and how much more often a gain must come in toxic
    windows than in ordinary ones; sizes: bytes of the toxic ones that are tried; counter: of the ordinary ones; rounds: of training; members:
    toxic texts, and a third of the ordinary ones, that they are trained on."""

    toxic: int = 1500
    ordinary: int = 4500
    longest: int = 20_000
    samples: int = 60_000
    window: int = 32
    taught: int = 16
    base: int = 16_384
    content: int = 6144
    better: float = 0.06
    saved: int = 3
    odds: float = 3.7
    committee: tuple[tuple[int, float], ...] = ((16, 5.0), (16, 8.0), (12, 5.0), (20, 5.0), (16, 3.0))
    sizes: tuple[int, ...] = (512, 1024)
    counter: int = 8192
    rounds: int = 3
    members: int = 200
    threshold: float = 0.7


#: What follows a dictionary's content and every window: the library indexes no match that begins in the last bytes.
PAD = b"\n" * 12


def windows(text: str, size: int) -> list[bytes]:
    """Consecutive windows of whole lower-case words, each of at least size bytes but the last."""
    out, own, n = [], [], 0
    for word in text.lower().encode("utf-8", "surrogatepass").split():
        own.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" " + b" ".join(own) + b" " + PAD)
            own, n = [], 0
    if own:
        out.append(b" " + b" ".join(own) + b" " + PAD)
    return out


def evenly(x: list, most: int) -> list:
    """At most so many members, evenly from all."""
    return x if len(x) <= most else [x[i * len(x) // most] for i in range(most)]


def trained(samples: list[bytes], size: int, k: int = 16, d: int = 6) -> bytes:
    """A dictionary that zstandard trains on the samples; of too few to train on, the samples themselves."""
    import zstandard

    samples = [w[: -len(PAD)] for w in samples]
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def compressor(content: bytes) -> Callable[[bytes], bytes]:
    import zstandard

    p = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=5, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=p).compress


def sizes(content: bytes, samples: list[bytes]) -> np.ndarray:
    """Compressed bytes of each window with a dictionary."""
    made = compressor(content + PAD)
    return np.array([len(made(w)) for w in samples], np.int32)


def gains(base: bytes, ordinary: bytes, toxic: bytes, samples: list[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window; both have the base's content before their own, and one length."""
    n = max(len(ordinary), len(toxic))
    return sizes(base + bytes(n - len(ordinary)) + ordinary, samples) - sizes(base + bytes(n - len(toxic)) + toxic, samples)


def telling(base: bytes, dictionary: bytes, counter: bytes, toxic: list[bytes], ordinary: list[bytes], s: Settings) -> dict[bytes, int]:
    """The parts of a toxic dictionary (what stands between spaces) that tell windows it was not trained on apart, with the toxic windows they save bytes in."""
    most = s.samples // 10
    hit = [[w for w, g in zip(x, gains(base, counter, dictionary, x)) if g >= s.saved] for x in (toxic, ordinary)]
    drawn = [evenly(x, most) for x in hit]
    scale = [len(x) / max(1, len(y)) for x, y in zip(hit, drawn)]
    plain = [sizes(base, x) for x in drawn]
    # a part saves nothing where none of its fives stands: the library finds no shorter match
    places: list[dict[bytes, set[int]]] = [defaultdict(set), defaultdict(set)]
    for own, x in zip(places, drawn):
        for i, w in enumerate(x):
            for k in range(len(w) - len(PAD) - 4):
                own[w[k : k + 5]].add(i)
    found = {}
    for part in dict.fromkeys(dictionary.split(b" ")[1:-1]):
        if not 3 <= len(part) <= 40:
            continue
        spelt, counts = b" " + part + b" ", []
        for own, x, p, m in zip(places, drawn, plain, scale):
            met = sorted(set().union(*(own.get(spelt[k : k + 5], ()) for k in range(len(spelt) - 4))))
            counts.append(m * int((p[met] - sizes(base + spelt, [x[i] for i in met]) >= s.saved).sum()) if met else 0.0)
        x, y = counts
        # the share of toxic windows is taken low, by as much as chance may have raised it
        if x >= 4 and np.log((x - 1.64 * x**0.5 + 0.5) / len(toxic)) - np.log((y + 0.5) / len(ordinary)) >= s.odds:
            found[part] = int(x)
    return found


def dictionaries(toxic: list[str], ordinary: list[str], s: Settings) -> tuple[bytes, bytes]:
    """(ordinary, toxic): dictionaries of one length that begin with the same content."""
    base = trained(evenly([w for t in ordinary for w in windows(t, 200)], s.samples), s.base, 64, 8)
    halves = []
    for texts in (toxic, ordinary):
        one, two = (dict.fromkeys(chain.from_iterable(windows(t, s.taught) for t in texts[k::2])) for k in (0, 1))
        halves.append([evenly(list(one), 2 * s.samples), evenly([w for w in two if w not in one], 2 * s.samples)])  # copies are in one half
    bad, good = halves
    if not all(map(all, halves)):
        return base + PAD, base + PAD
    # a dictionary of each half, judged by the other half's windows; the best of those train that half's second one
    counter = [trained(evenly(x, s.samples), s.content // 2) for x in good]
    first = [trained(evenly(x, s.samples), s.content) for x in bad]
    found: dict[bytes, int] = {}
    for own, other in ((0, 1), (1, 0)):
        saved = gains(base, counter[other], first[other], bad[own])
        best = [bad[own][i] for i in np.argsort(-saved, kind="stable")[: max(1, int(len(saved) * s.better))]]
        second = trained(best, s.content // 2)
        for part, n in telling(base, second, counter[own], bad[other], good[other], s).items():
            found[part] = max(n, found.get(part, 0))
    own = b"".join(b" " + part + b" " for part in sorted(found, key=lambda p: (found[p], p)))  # the most useful last
    return base + bytes(len(own)) + PAD, base + own + PAD


def content(dictionary: bytes) -> bytes:
    """What a trained dictionary holds after its tables, which end with the three offsets that all begin with."""
    at = dictionary.find(b"\1\0\0\0\4\0\0\0\x08\0\0\0")
    return dictionary[at + 12 :] if at >= 0 else dictionary


def cut_out(samples: list[bytes], size: int, k: int) -> bytes:
    """That many bytes of content trained on windows."""
    return content(trained(samples, size + 200, k, 6))[-size:]


def told_apart(base: bytes, toxic: list[list[bytes]], ordinary: list[list[bytes]], k: int, ratio: float, s: Settings) -> list[tuple[list[bytes], list[bytes]]]:
    """For each half (ordinary, toxic) windows to train on: those that the other half's dictionaries, after some rounds of this, tell apart
    or mistake."""
    pairs = [(cut_out(g, s.content, k), cut_out(b, s.content, k)) for g, b in zip(ordinary, toxic)]
    for turn in range(s.rounds):
        told = []
        for own in (0, 1):
            right, wrong = (gains(base, *pairs[1 - own], x[own]) for x in (toxic, ordinary))
            # the least gain that comes so much more often in toxic windows; where none does, that of the best fiftieth
            cut = next((c for c in range(1, 16) if (right >= c).sum() >= 8 and (right >= c).mean() >= ratio * (wrong >= c).mean()), None)
            cut = int(np.sort(right)[-max(8, len(right) // 50) :][0]) if cut is None else cut
            mistaken = [ordinary[own][i] for i in np.flatnonzero(wrong >= max(1, cut - 2))]
            told.append((mistaken if len(mistaken) >= 8 else ordinary[own][:64], [toxic[own][i] for i in np.flatnonzero(right >= cut)]))
        if turn + 1 < s.rounds:
            pairs = [(cut_out(g, s.counter, k), cut_out(b, max(s.sizes), k)) for g, b in told]
    return told


@dataclass
class Pair:
    """Two dictionaries with the gain that counts and the weights of a document's features; compressors are made where it is used."""

    ordinary: bytes
    toxic: bytes
    window: int
    cut: int = 1
    weights: np.ndarray | None = None
    compressors: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"compressors": None}

    def gains(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        if self.compressors is None:
            self.compressors = compressor(self.ordinary), compressor(self.toxic)
        a, b = self.compressors
        return np.array([len(a(w)) - len(b(w)) for w in windows(text, self.window)], np.int16)

    def calibrate(self, found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """Choose the gain that counts and the weights; the log odds of the texts."""
        tried = []
        for cut in range(1, 9):
            x = Scorer.features(found, cut)
            w, loss = Scorer._logistic(x, y)
            tried.append((loss, cut, w, x @ w))
        _, self.cut, self.weights, odds = min(tried, key=lambda t: t[:2])
        return odds


def _loss(odds: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -odds, odds)).mean())


class Scorer:
    """The pairs that were taken; picklable."""

    def __init__(self, toxic: list[str], ordinary: list[str], s: Settings = Settings()):
        self.settings, self.pairs = s, []
        toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
        self.prior = len(toxic) / max(1, len(toxic) + len(ordinary))
        found = [f for f in (self._sharp(toxic, ordinary), self._committee(toxic, ordinary)) if f]
        if found:
            self.loss, self.pairs = min(found, key=lambda f: f[0])

    def _sharp(self, toxic: list[str], ordinary: list[str]) -> tuple[float, list[Pair]] | None:
        """Every fourth text calibrates what the others train."""
        s = self.settings
        rest = [[t for i, t in enumerate(x) if i % 4] for x in (toxic, ordinary)]
        held = [[t for i, t in enumerate(x) if not i % 4] for x in (toxic, ordinary)]
        if not rest[0] or not rest[1]:
            return None
        pair = Pair(*dictionaries(*rest, s), s.window)
        y = np.array([1.0] * len(held[0]) + [0.0] * len(held[1]))
        return _loss(pair.calibrate([pair.gains(t) for t in [*held[0], *held[1]]], y), y), [pair]

    def _committee(self, toxic: list[str], ordinary: list[str]) -> tuple[float, list[Pair]] | None:
        """Dictionaries of one half calibrate on the other; those that score are of both."""
        s = self.settings
        toxic, ordinary = evenly(toxic, s.members), evenly(ordinary, 3 * s.members)
        if min(len(toxic), len(ordinary)) < 8:
            return None
        base = trained(evenly([w for t in ordinary for w in windows(t, 200)], s.samples), s.base, 64, 8)
        texts, halves = [(x[0::2], x[1::2]) for x in (toxic, ordinary)], []
        for x in texts:
            one, two = (dict.fromkeys(chain.from_iterable(windows(t, s.taught) for t in own)) for own in x)
            halves.append([evenly(list(one), s.samples), evenly([w for w in two if w not in one], s.samples)])  # copies are in one half
        if not all(map(all, halves)):
            return None
        y = np.array([label for h in (0, 1) for x, label in zip(texts, (1.0, 0.0)) for _ in x[h]])

        def pair(told: tuple[list[bytes], list[bytes]], size: int, k: int) -> Pair:
            counter, own = cut_out(told[0], s.counter, k), cut_out(told[1], size, k)
            return Pair(base + counter + bytes(len(own)) + PAD, base + counter + own + PAD, s.window)

        pairs, odds = [], []
        for k, ratio in s.committee:
            told = told_apart(base, *halves, k, ratio, s)
            both = [list(chain.from_iterable(x)) for x in zip(*told)]
            tried = []
            for size in s.sizes:
                half = [pair(t, size, k) for t in told]
                found = [half[1 - h].gains(t) for h in (0, 1) for x in texts for t in x[h]]
                own = pair(both, size, k)
                guess = own.calibrate(found, y)
                tried.append((_loss(guess, y), size, own, guess))
            _, _, own, guess = min(tried, key=lambda t: t[:2])
            pairs.append(own)
            odds.append(guess)
        return _loss(np.mean(odds, axis=0), y), pairs

    @staticmethod
    def features(gains: list[np.ndarray], cut: int) -> np.ndarray:
        rows = []
        for g in gains:
            n, over = max(1, len(g)), int((g >= cut).sum())
            rows.append((1.0, float(g.max(initial=0)), np.log1p(over), np.sqrt(over / n), float(np.maximum(g, 0).sum()) / n, np.log1p(n)))
        return np.array(rows).reshape(len(gains), 6)

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
        w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
        penalty[0, 0] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
        return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.pairs:
            return np.full(len(texts), self.prior)
        odds = [self.features([p.gains(t) for t in texts], p.cut) @ p.weights for p in self.pairs]
        return 1 / (1 + np.exp(-np.clip(np.mean(odds, axis=0), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Fit on a bounded sample, drawn by hash, of labelled rows whose crc32(id) mod 3 is not 1; of rows that repeat an id one counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter((fold(F.col("id"), 3) != 1) & F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20))
    most = {1: s.toxic, 0: s.ordinary}
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (draw < F.lit(min(1.0, most[y] / n) * (1 << 20))))
    drawn = known.filter(keep)
    start = F.pmod(F.xxhash64("id", F.lit(10)), F.greatest(F.lit(1), F.length("text") - s.longest + 1)).cast("int") + 1
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    cut = rows.join(F.broadcast(drawn), "id").select("id", "y", F.substring("text", start, F.lit(s.longest)).alias("text"))
    got = cut.groupBy("id", "y").agg(F.min("text").alias("text")).toPandas().sort_values(["id", "text"])  # about s.toxic + s.ordinary ids, once each
    return Scorer(got.text[got.y == 1].tolist(), got.text[got.y == 0].tolist(), s)


def classify(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, score (0 to 1) and predicted of every whole text, or with keep the input rows that are not predicted toxic.

    A null text is scored as the empty one. Where nothing could be learnt every score is the share of toxic
    labels. Repeated rows, ties and null ids keep one row each; an empty table gives none; other columns
    are not read (with keep they stay). One narrow pass, no shuffle.
    """
    model, most = docs.sparkSession.sparkContext.broadcast(scorer), scorer.settings.threshold
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(model.value.score([t or "" for t in batch.column(at).to_pylist()]) < most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(texts_of(batch)))], ["id", "score"])

    if keep:
        return docs.mapInArrow(kept, docs.schema)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= most).cast("int").alias("predicted"))
