"""Runs of repeated words: maximal stretches of at least four periods, found by block matching.

At scale k the words of a text are cut into aligned blocks of 2^k. A run of period q, 2^k <= q < 2^(k+1), is at
least 4q words long, so its first 3q - 1 words hold an aligned block whose words all stand again q words later,
inside the run. The blocks are integer sequences in a pyahocorasick automaton, which is led over the text; an
occurrence that ends q words after the block of the same words, q of that scale, is a seed: both copies are
extended in both directions for as long as the words agree, by comparing whole slices.

What can't be in a run isn't looked for. Each word of a run's first 3q has its like within q words, so only blocks
whose words all recur within 2^(k+1), next to such a block, become keys, and only the text that follows them within
reach is searched. Blocks whose whole reach lies in a run of a period of at most 2^k are left out as well: what repeats
there has a multiple of that period (Fine and Wilf). That keeps texts of one repeated word linear a scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm._common import slices

#: A run is at least this many periods and this many words long.
PERIODS, WORDS = 4, 6


def numbers(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first like."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def recurrence(ids: np.ndarray) -> np.ndarray:
    """Distance of each word to its next like; the text's length where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), max(len(ids), 1), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _reach(same: np.ndarray, other: np.ndarray) -> int:
    """How many leading members agree."""
    done, step = 0, 64
    while done < len(same):
        off = np.flatnonzero(same[done : done + step] != other[done : done + step])
        if len(off):
            return done + int(off[0])
        done += step
        step *= 2
    return len(same)


def extend(ids: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """The longest stretch around i..j (ids[i] equal to ids[j]) of period j - i: its start and end."""
    back = _reach(ids[i::-1], ids[j : j - i - 1 if j - i > 0 else None : -1])
    on = _reach(ids[i : len(ids) - (j - i)], ids[j:])
    return i - back + 1, j + on


def _primes(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + ([q] if q > 1 else [])


def primitive(ids: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether no proper divisor of q is a period of the stretch: then q is its smallest, for it has four of them."""
    return not any(np.array_equal(ids[start : end - q // p], ids[start + q // p : end]) for p in _primes(q))


def _candidates(near: np.ndarray, size: int) -> np.ndarray:
    """Aligned blocks whose words all recur in time, next to such a block; near: for each block its words' largest recurrence."""
    fits = near < 2 * size
    if not fits.any():
        return np.empty(0, np.int64)
    beside = np.zeros_like(fits)
    beside[:-1] |= fits[1:]
    beside[1:] |= fits[:-1]
    return np.flatnonzero(fits & beside)


def _seeds(ids: np.ndarray, blocks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Places (i, j) of a block and of its words again, size <= j - i < 2 * size, from left to right."""
    from ahocorasick import KEY_SEQUENCE, STORE_INTS, Automaton

    rows = ids[blocks[:, None] * size + np.arange(size)]
    kinds, first, kind = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)
    keys = Automaton(STORE_INTS, KEY_SEQUENCE)
    for name, row in enumerate(rows[first].tolist()):
        keys.add_word(tuple(row), name)
    keys.make_automaton()
    kind_of = dict(zip(blocks.tolist(), kind.tolist()))
    # the text in reach of the blocks, overlapping reaches as one
    starts = (blocks + 1) * size
    ends = np.minimum(starts + 2 * size, len(ids))
    cut = np.flatnonzero(np.append(True, starts[1:] > np.maximum.accumulate(ends)[:-1]))
    for a, b in zip(starts[cut].tolist(), np.append(ends[cut[1:] - 1], ends[-1]).tolist()):
        for at, name in keys.iter(tuple(ids[a:b].tolist())):
            j = a + at - size + 1
            block = (j - size) // size  # the one aligned block at a distance of this scale
            if kind_of.get(block) == name:
                yield block * size, j


def find(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start, then period."""
    n = len(ids)
    found: list[tuple[int, int, int]] = []
    if n < WORDS:
        return found
    near, size = recurrence(ids), 1
    while PERIODS * size <= n:
        blocks = _candidates(near, size)
        if len(blocks) and found:
            low = blocks * size
            high = np.minimum(low + 3 * size, n)
            covered = np.zeros(len(blocks), bool)
            if small := sorted((s, s + length) for s, length, q in found if q <= size):
                starts, ends = np.array(small).T
                # the run that ends last of those that start before the block
                at = np.searchsorted(starts, low, side="right") - 1
                covered = (at >= 0) & (np.maximum.accumulate(ends)[np.maximum(at, 0)] >= high)
            blocks = blocks[~covered]
        if len(blocks):
            reached: dict[int, int] = {}  # of each period the end of the last stretch
            for i, j in _seeds(ids, blocks, size):
                q = j - i
                if j + size <= reached.get(q, 0):
                    continue
                start, end = extend(ids, i, j)
                reached[q] = end
                if end - start >= max(WORDS, PERIODS * q) and primitive(ids, start, end, q):
                    found.append((start, end - start, q))
        size *= 2
        half = len(near) // 2
        near = np.maximum(near[: 2 * half : 2], near[1 : 2 * half : 2])
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left when of each run only its first period stays, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep)])


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # white space of bytes is 0x20 and 0x09 to 0x0D


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in slices(batches):
        sizes, runs, left = [], [], []
        for text in batch.column(1).to_pylist():
            words = _split(text)
            own = find(numbers(words))
            sizes.append(len(words))
            runs.append([{"start": s, "length": length, "period": q} for s, length, q in own])
            left.append(collapsed(words, own))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(left, pa.binary())], ["id", "n_words", "runs", "collapsed"])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (array of start, length, period in words; by start, then period) and collapsed (the text without the
    repeats, words joined by one space) of every row.

    Words are separated by white space (0x20, 0x09 to 0x0D) and compared as they stand. A run is at least six words and
    four of its smallest period. Null and empty texts have no words. Rows repeat as they do in the input, null ids are
    kept, an empty table gives none; other columns are not read. A text is one task's work, of memory in proportion
    to it; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_found, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start, then period) and sha256 of the
    list of runs and of the collapsed text, of what runs() gives."""
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period)), '\n')")
    top = found.withColumn("top", longest)
    return top.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.less")).alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * -F.col("top.less") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def refrain(words: list[bytes], name: str) -> list[bytes] | None:
    """The words with a stretch repeated to the end, where 10 divides the crc32 of the name; else None."""
    h, n = crc32(name.encode()), len(words)
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * (-(-(n - a) // p)))[: n - a]


def _refrains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = []
        for name, text in zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1)):
            own = None if name is None or crc32(name.encode()) % 10 else refrain(_split(text.as_py()), name)
            texts.append(text.as_py() if own is None else b" ".join(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], batch.schema.names)


def with_refrain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text (binary) of every row, one text in ten with words that repeat to its end; rows without id as they are."""
    rows = docs.select(id_col, F.col(text_col).cast("binary").alias(text_col))
    return rows.mapInArrow(_refrains, T.StructType([rows.schema[id_col], T.StructField(text_col, T.BinaryType())]))
