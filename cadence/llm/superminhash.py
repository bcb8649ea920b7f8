"""Near duplicates by SuperMinHash signatures.

Every member of a set (a shingle's hash) deals the signature's places out in an order of its own, a random
permutation: in its j-th turn it puts j plus a random fraction on the j-th place of that order, and a place keeps
the least value put there. The ranks of one member are thus spread over all places (they can't all be small), which
is what lowers the variance below that of independent minima. A value of turn j is at least j, so a set whose places
are all taken after a turn is done: long sets stop after the first.

Sets meet by bands of their signatures; the bytes of signatures and the sizes discard, and what is left is compared as
whole sets. Equal sets are one node from the start. A band that many sets share is cut into tiles, and every tile and
every partition give a spanning forest only (union-find), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import pinned, slices, staged, texts_of
from cadence.llm._graph import components
from cadence.llm.simhash import _split, bounds, common, hashes, tiles, whole_groups

#: Places of a signature, bands of it, how far below the wanted similarity the signatures of a pair may agree (five and a half
#: standard errors), and members of the sets that turns are taken for at a time.
PLACES, BANDS, MARGIN, CHUNK = 128, 32, 0.2, 1 << 16
NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _turn(members: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """What each member draws in its j-th turn: which of the places left, and the value put there (j, then 56 random bits)."""
    drawn = _mix(members + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
    place = np.uint64(j) + (((drawn >> np.uint64(32)) * np.uint64(PLACES - j)) >> np.uint64(32))
    return place.astype(np.int64), (np.uint64(j) << np.uint64(56)) | (_mix(drawn ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(8))


def _turns(members: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Turns 1 and on for the sets that the first turn left places of; out has the first turn's values."""
    order = np.tile(np.arange(PLACES, dtype=np.uint8), (len(members), 1))
    place, _ = _turn(members, 0)
    order[np.arange(len(members)), place] = 0
    for j in range(1, PLACES):
        rows = np.arange(len(members))
        place, value = _turn(members, j)
        own = order[rows, place]
        order[rows, place] = order[:, j]
        np.minimum.at(out, (owner, own), value)
        going = (out == NONE).any(1)[owner]
        if not going.any():
            return
        if going.sum() < 0.8 * len(members):
            members, owner, order = members[going], owner[going], order[going]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PLACES values a set (distinct hashes); an empty set's are NONE."""
    out = np.full((len(sets), PLACES), NONE)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    owner, members = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    place, value = _turn(members, 0)
    np.minimum.at(out, (owner, place), value)
    left = np.flatnonzero((out == NONE).any(1) & (sizes > 0))
    starts, at = np.cumsum(sizes) - sizes, 0
    while at < len(left):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[left[at:]]), CHUNK, side="right")))
        some = left[at:to]
        own = np.concatenate([members[starts[k] : starts[k] + sizes[k]] for k in some])
        part = out[some]
        _turns(own, np.repeat(np.arange(len(some)), sizes[some]), part)
        out[some] = part
        at = to
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each row: a mix of its values and its number."""
    parts = signature.reshape(len(signature), BANDS, -1)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(parts.shape[2]):
        key = _mix(key ^ parts[:, :, k])
    return key


class Forest:
    """Union-find: of the edges added, those are kept that join two trees."""

    def __init__(self) -> None:
        self.parent: dict[bytes, bytes] = {}
        self.edges: list[tuple[bytes, bytes]] = []

    def root(self, x: bytes) -> bytes:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def join(self, a: bytes, b: bytes) -> None:
        if (x := self.root(a)) != (y := self.root(b)):
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def _verified(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 times the intersection is at least percent times the union, of whole sets."""
    out, start = np.zeros(len(others), bool), 0
    sizes = np.array([len(o) for o in others], np.int64)
    while start < len(others):  # about a million members at a time
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 1 << 20, side="right")))
        both = common(own, others[start:stop])
        out[start:stop] = 100 * both >= percent * (len(own) + sizes[start:stop] - both)
        start = stop
    return out


def _links(percent: int, exact: bool):
    """Rows of tiles (node, n, marks, and with exact shingles) -> edges whose components are those of all links in a tile:
    pairs that sizes and signatures don't tell apart, with exact only those that the whole sets confirm."""
    least = (percent / 100 - MARGIN) * PLACES

    def grow(names: list[bytes], n: np.ndarray, marks: np.ndarray, members, forest: Forest) -> None:
        left = np.arange(len(names))
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = left[(100 * np.minimum(n[left], n[x]) >= percent * np.maximum(n[left], n[x]))]
                near = near[(marks[near] == marks[x]).sum(1) >= least]
                if exact and len(near):
                    near = near[_verified(members(x), [members(k) for k in near], percent)]
                if len(near):
                    for k in near:
                        forest.join(names[x], names[k])
                    queue += near.tolist()
                    left = np.setdiff1d(left, near, assume_unique=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for tile, (node, n, marks, *sets) in whole_groups(batches):
            names, n = node.to_pylist(), n.to_numpy()
            marks = np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(-1, PLACES)
            for s, size in zip(*bounds(tile)):
                e = s + size
                grow(names[s:e], n[s:e], marks[s:e], lambda k, s=s: np.frombuffer(sets[0][int(s + k)].as_buffer(), np.uint64), forest)
        a, b = zip(*forest.edges) if forest.edges else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _tiled(keys: DataFrame, nodes: DataFrame, percent: int, exact: bool, weight: str | None = None) -> DataFrame:
    columns = ["node", "n", "marks", *(["shingles"] if exact else [])]
    tiled = tiles(keys, "node", weight).join(nodes.select(*columns), "node").select("key", "low", "high", *columns)
    return tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_links(percent, exact), "a binary, b binary")


def node_of(members: np.ndarray) -> bytes:
    """128-bit name of a set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(members.tobytes())


def _sketches(words: int):
    """Rows (id, text) -> (id, n, node, marks, keys); without words the last three are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [hashes(_split(t), words) for t in texts_of(batch)]
            found = signatures(sets)
            keys, marks = bands(found).view(np.int64), (found & np.uint64(255)).astype(np.uint8)
            nodes = [node_of(s) if len(s) else None for s in sets]
            kept = np.array([len(s) > 0 for s in sets], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept * BANDS)).astype(np.int32)), pa.array(keys[kept].reshape(-1)))
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([m.tobytes() if k else None for m, k in zip(marks, kept)], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "node", "marks", "keys"])

    return run


def _sets(words: int):
    """Rows (text) -> (node, shingles): the text's shingle hashes, ascending, of those that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [hashes(_split(t), words) for t in texts_of(batch)]
            held = [s.tobytes() for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets if len(s)], pa.binary()), pa.array(held, pa.binary())], ["node", "shingles"])

    return run


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable over links) and kept (the id is its component's) of every row.

    A text's set are its distinct word shingles (A-Z lower-cased, words between ASCII white space; a text of fewer words is
    one shingle; shingles are 64-bit hashes). Texts are linked if 100 times their sets' intersection is at least percent
    times the union; a pair just at 80 meets by no band, or is told apart by its bytes, once in some ten million. Without
    words a text is linked with nothing, its component is itself. Rows repeat as they do in the input; ids that repeat
    with different texts keep a row each. A null id never names a component that has others; one without an id has
    component null and is kept. An empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    prints = staged(rows.mapInArrow(_sketches(words), f"id {kind}, n long, node binary, marks binary, keys array<long>"))
    nodes = staged(prints.filter("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("marks").alias("marks"), F.min("keys").alias("keys")))
    keys = nodes.select("node", F.explode("keys").alias("key"))
    maybe = pinned(components(_tiled(keys, nodes, percent, exact=False)))
    # the sets of texts that may be linked, once each; members of a component meet at its root
    one = nodes.select("node", "first", "n", "marks").join(maybe, "node")
    texts = rows.join(one.select("first").distinct(), F.col("id").eqNullSafe(F.col("first")), "left_semi").select("text")
    sets = staged(texts.mapInArrow(_sets(words), "node binary, shingles binary").dropDuplicates(["node"]).join(one.drop("first"), "node"))
    weighed = sets.select("node", F.xxhash64("root").alias("key"), F.col("n").alias("weight"))
    found = components(_tiled(weighed, sets, percent, exact=True, weight="weight"))
    linked = found.join(nodes.select("node", "first"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("node", "least")
    by = pinned(nodes.select("node", "first").join(named, "node", "left").select("node", F.coalesce("least", "first").alias("least")))
    out = prints.select("id", "n", "node").join(by, "node", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = """
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) <= 4 then [array_to_string(w, ' ')]
        else list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) end as s from words
), nodes as (
    select min(doc_id) as node, s, len(s) as n from sets where len(s) > 0 group by s
), members as (
    select node, n, unnest(s) as shingle from nodes
), shared as (
    select a.node as a, b.node as b, count(*) as hits, any_value(a.n) as na, any_value(b.n) as nb
    from members a join members b on a.shingle = b.shingle and a.node < b.node and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.node, b.node
), links as (
    select a, b from shared where 100 * hits >= 80 * (na + nb - hits) union select b, a from shared where 100 * hits >= 80 * (na + nb - hits)
), reach as (
    select node, node as least from nodes union select l.b, r.least from reach r join links l on l.a = r.node
), named as (
    select node, min(least) as least from reach group by node
)
select s.doc_id, len(s.s) as n_shingles, coalesce(m.least, s.doc_id) as component_id, s.doc_id = coalesce(m.least, s.doc_id) as kept
from sets s left join nodes n on n.s = s.s left join named m on m.node = n.node
"""
