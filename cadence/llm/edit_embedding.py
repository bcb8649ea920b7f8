"""Document fingerprints by a randomised edit embedding.

A walk reads a text's characters; at step j on character c a shared random table says how many steps
the walk stays there before it moves on, so an insertion or deletion is caught up after a few
characters and edit distance becomes Hamming distance of what the walk reads. The fingerprint samples
the walk: in each of 64 bins the sampled step is the one of least random priority among the steps the
walk has, so texts of like length sample the same steps. A sample is one byte, a hash of the step and of
the characters from there on. Likeness is the share of equal samples.

``links`` finds texts of like fingerprints: bit-sampled bands of the samples are the join keys, texts that share
one are verified by likeness, and the links that remain by banded edit distance of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import pinned, slices

#: Samples of a fingerprint, walks that give them, period of a walk's table, characters that a sample hashes.
BINS, WALKS, PERIOD, GRAM = 64, 2, 256, 4
#: Most ranges of ids that a table is dealt into; bounds of them are what reaches the driver.
PARTS = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=WALKS)
def stay(which: int = 0) -> tuple[np.ndarray, list[bytes]]:
    """Steps that the walk stays on a character (by its low byte mix), by step modulo PERIOD: geometric, mean 2."""
    moves = np.random.default_rng(33 + which).integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    moves[0] = 1  # every run ends
    out = np.zeros((PERIOD, 256), np.uint8)
    run = np.ones(256, np.uint8)
    for j in range(2 * PERIOD - 1, -1, -1):  # twice round, as runs cross the end of the table
        run = np.where(moves[j % PERIOD] == 1, 1, np.minimum(run + 1, 250)).astype(np.uint8)
        out[j % PERIOD] = run
    return out.reshape(-1), [r.tobytes() for r in out]


@lru_cache(maxsize=None)
def records(limit: int) -> list[np.ndarray]:
    """For each bin the steps below limit that are of least priority so far: a walk of n steps samples the last below n."""
    bins = BINS // WALKS
    best = np.full(bins, np.uint64(2**64 - 1))
    found: list[list[int]] = [[] for _ in range(bins)]
    for a in range(0, limit, 1 << 20):
        j = np.arange(a, min(limit, a + (1 << 20)), dtype=np.uint64)
        h = _hash(j)
        b, p = (h & np.uint64(bins - 1)).astype(np.int64), h >> np.uint64(6)
        hit = np.flatnonzero(p < best[b])
        for k in hit.tolist():
            if p[k] < best[b[k]]:
                best[b[k]] = p[k]
                found[b[k]].append(int(j[k]))
    return [np.array(f, np.int64) for f in found]


def classes(text: str) -> np.ndarray:
    """One byte for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def walk(texts: list[np.ndarray], starts: list[int] | None = None, which: int = 0) -> list[np.ndarray]:
    """The step at which the walk comes to each character, and at last its length; starts: the first step of each."""
    flat, rows = stay(which)
    n = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-n, kind="stable")
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n[order] + 1, out=offset[1:])
    chars = np.zeros(int(offset[-1]) + 1, np.uint8)
    for o, k in zip(offset.tolist(), order.tolist()):
        chars[o : o + len(texts[k])] = texts[k]
    at = np.zeros(int(offset[-1]) + 1, np.int64)
    step = np.array(starts or [0] * len(texts), np.int64)[order]
    size, i, active = n[order], 0, len(texts)
    first = offset[:-1].copy()
    longest = int(size[0]) if len(size) else 0
    while i < longest:
        active = int(np.searchsorted(-size[:active], -i, side="left"))  # texts longer than i
        if active < 48:
            break
        s, w = step[:active], first[:active] + i
        at[w] = s
        s += flat[((s & (PERIOD - 1)) << 8) | chars[w]]
        i += 1
    at[first + np.minimum(size, i)] = step
    for k in range(active if i < longest else 0):  # few long texts are left: one by one
        o, j, own = int(first[k]), int(step[k]), []
        add = own.append
        for c in chars[o + i : o + int(size[k])].tobytes():
            add(j)
            j += rows[j & (PERIOD - 1)][c]
        add(j)
        at[o + i : o + int(size[k]) + 1] = own
    out: list[Any] = [None] * len(texts)
    for o, k in zip(offset.tolist(), order.tolist()):
        out[k] = at[o : o + len(texts[k]) + 1]
    return out


def sample(chars: np.ndarray, walks: list[np.ndarray]) -> np.ndarray:
    """The samples of a text by its walks: BINS bytes, 0 where a short walk has no step."""
    return np.concatenate([_sample(chars, at, which) for which, at in enumerate(walks)])


def _sample(chars: np.ndarray, at: np.ndarray, which: int) -> np.ndarray:
    total = int(at[-1])
    lists = records(1 << max(20, total.bit_length()))
    picked = np.array([(f[k - 1] if (k := np.searchsorted(f, total)) else -1) for f in lists], np.int64)
    out = np.zeros(len(lists), np.uint8)
    have = np.flatnonzero(picked >= 0)
    place = np.searchsorted(at, picked[have], side="right") - 1
    gram = np.full(len(have), which, np.uint64)
    for g in range(GRAM):
        c = np.where(place + g < len(chars), chars[np.minimum(place + g, len(chars) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        gram = gram * np.uint64(257) + c
    out[have] = 1 + (_hash(gram ^ (picked[have].astype(np.uint64) << np.uint64(36))) % np.uint64(255)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples among those that either has; two empty fingerprints are alike."""
    either = (a > 0) | (b > 0)
    return float((a == b)[either].mean()) if either.any() else 1.0


def fingerprint_texts(texts: list[str]) -> list[np.ndarray]:
    chars = [classes(t) for t in texts]
    return [sample(c, list(w)) for c, w in zip(chars, zip(*[walk(chars, which=k) for k in range(WALKS)]))]


def above(bounds: list, value: Column) -> Column:
    """How many of the descending bounds are above a value, by halving."""
    if not bounds:
        return F.when(value.isNotNull(), 0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    held = F.lit(bounds)
    take = lambda n, step: F.when((n + step <= len(bounds)) & (F.element_at(held, F.least(n + step, F.lit(len(bounds)))) > value), n + step).otherwise(n)
    return F.when(value.isNotNull(), F.aggregate(F.lit(steps), F.lit(0), take))


def neighbours(docs: DataFrame, id_col: str, text_col: str, bytes_each: int = 24 << 20) -> DataFrame:
    """(part, id, text, lead): ranges of ids, each with the first row of the next range below (lead) after its own rows.

    Bounds come from approximate quantiles of the id and the input's size, so parts hold about bytes_each
    of text; only as many bounds and first ids as there are parts reach the driver. Null ids come last.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(PARTS, max(1, int(size // bytes_each), docs.sparkSession.sparkContext.defaultParallelism))
    bounds = sorted(set(rows.select(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], max(10_000, 10 * parts)).alias("q")).first()[0] or []), reverse=True)
    rows = rows.withColumn("part", F.coalesce(above(bounds, F.col("id")), F.lit(len(bounds) + 1)))
    heads = {r["part"]: r["id"] for r in rows.groupBy("part").agg(F.max("id").alias("id")).collect()}
    order = sorted(heads)
    if len(order) < 2:
        rows = rows.select("part", "id", "text", F.lit(False).alias("lead"))
    else:
        # a part's first rows go to the part above as well: a row for each part, broadcast
        firsts = docs.sparkSession.createDataFrame([(p, q, heads[p]) for q, p in zip(order, order[1:])], f"part int, up int, first {rows.schema['id'].dataType.simpleString()}")
        held = rows.join(F.broadcast(firsts), "part", "left")
        own, lead = F.struct(F.col("part").alias("part"), F.lit(False).alias("lead")), F.struct(F.col("up").alias("part"), F.lit(True).alias("lead"))
        at = F.when(F.col("up").isNotNull() & F.col("id").eqNullSafe(F.col("first")), F.array(own, lead)).otherwise(F.array(own))
        rows = held.select("id", "text", F.explode(at).alias("at")).select("at.part", "id", "text", "at.lead")
    return rows.repartition(len(order) or 1, "part").sortWithinPartitions("part", "lead", F.desc_nulls_last("id"), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and candidate of every row.

    The edited text of a row has its last half (rounded down) replaced by as many first code points of the next
    row by descending id, or by all of it; the last row's next is the first. A null text is empty; equal texts
    have equal fingerprints; two empty texts are alike (1.0). Rows with equal ids are ordered by their texts; a
    table of one row is its own next; an empty one gives none. candidate: whether the text and its edited text share a
    band, so that ``links`` would compare them. Other columns are not read. One shuffle of the texts by ranges of ids.
    """
    spark = docs.sparkSession
    first = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    top = first.agg(F.max("id").alias("id"), F.count("*").alias("n")).first()
    if not top["n"]:
        head = ""
    else:
        same = F.col("id") == F.lit(top["id"]) if top["id"] is not None else F.col("id").isNull()
        head = first.filter(same).orderBy("text").limit(1).first()["text"]  # one text: the last row's next
    head_text = spark.sparkContext.broadcast(head)
    kind = first.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held: tuple | None = None  # a row that waits for its next

        def give(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
            texts = [r[2] for r in rows]
            after = [r[2] for r in following]
            chars = {}
            for t in {*texts, *after}:
                chars[t] = classes(t)
            names = list(chars)
            walks = dict(zip(names, zip(*[walk([chars[t] for t in names], which=k) for k in range(WALKS)])))
            prints = {t: sample(chars[t], walks[t]) for t in names}
            edited, tails, begin, keep = [], [], [], []
            for t, u in zip(texts, after):
                h = len(t) // 2
                k = len(t) - h
                edited.append(t[:k] + u[:h])
                keep.append(k)
                tails.append(np.concatenate([chars[u][:h]]))
                begin.append([int(w[k]) for w in walks[t]])
            moved = list(zip(*[walk(tails, [b[k] for b in begin], k) for k in range(WALKS)]))
            out = []
            for t, u, e, k, tail, m in zip(texts, after, edited, keep, tails, moved):
                p = sample(np.concatenate([chars[t][:k], tail]), [np.concatenate([w[:k], x]) for w, x in zip(walks[t], m)])
                out.append((len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), prints[t].tobytes().hex(), p.tobytes().hex(), likeness(prints[t], p), likeness(prints[t], prints[u]), p))
            both = [bands(np.array(x)) for x in ([prints[t] for t in texts], [r[-1] for r in out])]
            out = [(*r[:-1], bool(c)) for r, c in zip(out, (both[0] == both[1]).any(1))]
            columns = [pa.array([r[1] for r in rows], kind_arrow)] + [pa.array(c) for c in zip(*out)]
            return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "candidate"])

        kind_arrow = None
        for batch in slices(batches):
            kind_arrow = batch.schema.field("id").type
            rows = list(zip(*[batch.column(k).to_pylist() for k in range(4)]))
            now, nxt = [], []
            for row in rows:
                if held is not None and (row[0] != held[0]):
                    now.append(held)  # the last of its part, with no lead: the very last row
                    nxt.append((0, None, head_text.value, False))
                    held = None
                if row[3]:
                    if held is not None:
                        now.append(held)
                        nxt.append(row)
                        held = None
                    continue
                if held is not None:
                    now.append(held)
                    nxt.append(row)
                held = row
            if now:
                yield give(now, nxt)
        if held is not None:
            yield give([held], [(0, None, head_text.value, False)])

    out = neighbours(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, candidate boolean")
    return out.withColumnRenamed("id", id_col)


def bands(prints: np.ndarray, count: int = 24, width: int = 3) -> np.ndarray:
    """Bit-sampled bands: count keys, each of the bits of width samples of one walk, drawn once for all."""
    draw = np.random.default_rng(44)
    keys = np.zeros((len(prints), count), np.uint64)
    for k in range(count):
        x = np.zeros(len(prints), np.uint64)
        own = BINS // WALKS
        for s in k % WALKS * own + draw.choice(own, width, replace=False):
            x = x * np.uint64(256) + prints[:, s].astype(np.uint64)
        keys[:, k] = _hash(x + (np.uint64(k) << np.uint64(48)))
    return keys


def links(docs: DataFrame, least: float = 0.3, most: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, edges): node and id of every row, and (a, b, likeness, distance) between nodes whose texts edits separate.

    Equal texts are one node (60 bits of their digest), whatever their ids: rows without id, and rows of one id with different texts, are all there. Nodes that share a band meet; groups of a common band are
    dealt into tiles and each gives a forest of links of at least ``least`` likeness, never all pairs. Each link is
    then verified on the whole texts: its edit distance is at most ``most`` of the longer text.
    """
    from cadence.llm.simhash import bounds, tiles, whole_groups

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array(fingerprint_texts([t or "" for t in batch.column(1).to_pylist()])).reshape(-1, BINS)
            keys = bands(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in found], pa.binary()), lists], ["node", "print", "keys"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, (node, marks) in whole_groups(batches):
            nodes, marks = node.to_numpy(), np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(-1, BINS)
            out: list[tuple] = []
            for s, n in zip(*bounds(tile)):
                left = np.arange(s, s + n)
                while len(left) > 1:
                    queue, left = [left[0]], left[1:]
                    while queue and len(left):
                        x = queue.pop()
                        either = ((marks[left] > 0) | (marks[x] > 0)).sum(1)
                        like = ((marks[left] == marks[x]) & (marks[x] > 0)).sum(1) / np.maximum(either, 1)
                        near = np.flatnonzero(like >= least)
                        out += [(int(nodes[left[k]]), int(nodes[x]), float(like[k])) for k in near]
                        queue += left[near].tolist()
                        left = np.delete(left, near)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "likeness"])

    digest = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", digest)
    texts = rows.select("node", "text").dropDuplicates(["node"])
    marked = pinned(texts.mapInArrow(prints, "node long, print binary, keys array<long>"))
    tiled = tiles(marked.select("node", F.explode("keys").alias("key")), "node").join(marked.select("node", "print"), "node").select("key", "low", "high", "node", "print")
    met = tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(compare, "a long, b long, likeness double").distinct()
    pairs = met.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [edit_distance(x, y, int(most * max(len(x), len(y)))) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            keep = [d <= int(most * max(len(x), len(y))) for d, x, y in zip(size, batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64())], ["a", "b", "likeness", "distance"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("node", "id"), pairs.select("a", "b", "likeness", "x", "y").mapInArrow(verify, "a long, b long, likeness double, distance long")


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance if at most ``most``, else most + 1; by diagonals, in time length x most at worst."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32), np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)

    def slide(i: int, j: int) -> int:
        n = 0
        while i + n < len(x) and j + n < len(y):
            step = min(256, len(x) - i - n, len(y) - j - n)
            differ = np.flatnonzero(x[i + n : i + n + step] != y[j + n : j + n + step])
            if len(differ):
                return n + int(differ[0])
            n += step
        return n

    goal, reach = len(y) - len(x), {0: slide(0, 0)}
    for d in range(most + 1):
        if reach.get(goal, -1) >= len(x):
            return d
        new = {}
        for k in range(-d - 1, d + 2):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            i = min(i, len(x), len(y) - k)
            if i >= 0 and i + k >= 0:
                new[k] = i + slide(i, i + k)
        reach = new
    return most + 1
