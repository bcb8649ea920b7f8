"""SimHash near-duplicates with pivot distance tables.

Reference fingerprints (pivots) are fixed. For every value of each block of the fingerprint a table
holds its Hamming distances to the pivots' block, so a fingerprint's distances to all pivots are sums
of table rows. Two fingerprints at most D bits apart

* agree in some blocks whole when there are more blocks than D, hence have the same pivot distances
  there: those are the join keys (distances to many pivots identify a block, which is checked when the
  tables are made, so candidates meet as blocks do; of whole fingerprints pivot distances alone crowd round half
  the bits and join nothing);
* differ in no pivot distance by more than D: pairs with a larger coordinate difference are discarded,
  and the survivors are verified by their bits.

Equal fingerprints are one node from the start, so exact copies cost nothing. A key shared by many
different fingerprints is cut into tiles, each tile gives the edges of a spanning forest only (never all
pairs), and components are found over those edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cadence.llm._common import pinned, slices, staged, texts_of, trim
from cadence.llm._graph import components

#: Seed of the shingles' XXH64, number of pivots, and fingerprints (and shingles, where sets are compared) of one key that a tile side holds.
SEED, PIVOTS, TILE, LOAD = 42, 16, 1024, 1 << 21


def fingerprints(texts: list[str], words: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text: lower-case A-Z, words between ASCII white space, repeated shingles count again."""
    from xxhash import xxh64_digest

    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        found = text.encode("utf-8", "surrogatepass").lower().split()
        if not found:
            continue
        joined = b" ".join(found)
        if len(found) <= words:
            digests = xxh64_digest(joined, SEED)
        else:
            ends = list(accumulate(len(w) + 1 for w in found))
            starts = [0, *ends]
            digests = b"".join([xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])])
        rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        ones = np.zeros(64, np.int64)
        for a in range(0, len(rows), 65536):
            ones += np.unpackbits(rows[a : a + 65536], axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(rows)).view(">u8")[0]
    return out


class PivotTables:
    """Distances of block values to the pivots' blocks, for links of at most ``distance`` bits."""

    def __init__(self, distance: int):
        self.distance = distance
        n = distance + 2  # at least two blocks of a linked pair agree
        width = [64 // n + (i < 64 % n) for i in range(n)]
        self.shift = [sum(width[:i]) for i in range(n)]
        self.mask = [(1 << w) - 1 for w in width]
        pivots = np.random.default_rng(20).integers(0, 2**63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(21).integers(0, 2, PIVOTS, dtype=np.uint64)
        self.tables, self.profiles = [], []
        for s, m in zip(self.shift, self.mask):
            own = (pivots >> np.uint64(s)) & np.uint64(m)
            table = np.bitwise_count(np.arange(m + 1, dtype=np.uint64)[:, None] ^ own).astype(np.int8)
            profile = (table.astype(np.uint64) << (4 * np.arange(PIVOTS, dtype=np.uint64))).sum(1, dtype=np.uint64)
            if len(np.unique(profile)) != m + 1:
                raise ValueError("the pivots don't tell all values of a block apart")
            self.tables.append(table)
            self.profiles.append(profile)
        self.agree = list(combinations(range(n), 2))

    def blocks(self, prints: np.ndarray) -> list[np.ndarray]:
        return [((prints >> np.uint64(s)) & np.uint64(m)).astype(np.int64) for s, m in zip(self.shift, self.mask)]

    def distances(self, prints: np.ndarray) -> np.ndarray:
        """Hamming distance of each fingerprint to each pivot."""
        out = np.zeros((len(prints), PIVOTS), np.int8)
        for table, block in zip(self.tables, self.blocks(prints)):
            out += table[block]
        return out

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """A join key for each pair of blocks: a mix of the blocks' pivot distances."""
        own = [p[b] for p, b in zip(self.profiles, self.blocks(prints))]
        out = np.empty((len(prints), len(self.agree)), np.uint64)
        for k, (i, j) in enumerate(self.agree):
            x = (own[i] ^ (own[j] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, k] = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return out

    def forest(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect all fingerprints of a group which links of its own connect; at most one less than members."""
        where = self.distances(prints)
        left, edges = np.arange(len(prints)), []
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.flatnonzero((np.abs(where[left] - where[x]) <= self.distance).all(1))
                near = near[np.bitwise_count(prints[left[near]] ^ prints[x]) <= self.distance]
                if len(near):
                    edges += [(int(y), int(x)) for y in left[near]]
                    queue += left[near].tolist()
                    left = np.delete(left, near)
        return edges


@lru_cache(maxsize=4)
def tables(distance: int) -> PivotTables:
    return PivotTables(distance)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(distance)
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            keys = t.keys(prints)
            yield pa.RecordBatch.from_arrays([_signed(keys.reshape(-1)), _signed(np.repeat(prints, keys.shape[1]))], ["key", "fp"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Rows sorted by their first columns -> (first columns, other columns) of whole groups, many at a time."""
    tile, held = np.empty((0, keys), np.int64), []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = np.vstack([tile, np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)])
        held.append(batch)
        if (tile[0] == tile[-1]).all():
            continue
        # the last group may go on in the next batch
        whole = len(tile) - int(np.argmin((tile[::-1] == tile[-1]).all(1)))
        rows = pa.Table.from_batches(held).combine_chunks()
        yield tile[:whole], [c.combine_chunks() for c in rows.slice(0, whole).columns[keys:]]
        tile, held = tile[whole:], rows.slice(whole).to_batches()
    if len(tile):
        yield tile, [c.combine_chunks() for c in pa.Table.from_batches(held).columns[keys:]]
    del tile, held
    trim()


def bounds(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each group."""
    cut = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(1)))
    return cut, np.diff(np.append(cut, len(tile)))


def _linked(distance: int):
    """Rows of tiles -> edges."""

    def groups(t: PivotTables, tile: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut, size = bounds(tile)
        two = cut[size == 2]
        two = two[(np.abs(t.distances(fp[two]) - t.distances(fp[two + 1])) <= distance).all(1)]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [fp[two]], [fp[two + 1]]
        for s, n in zip(cut[size > 2], size[size > 2]):
            own = fp[s : s + n]
            if found := t.forest(own):
                x, y = np.array(found).T
                a.append(own[x])
                b.append(own[y])
        return pa.RecordBatch.from_arrays([_signed(np.concatenate(a)), _signed(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(distance)
        for tile, (fp,) in whole_groups(batches):
            yield groups(t, tile, fp.to_numpy().view(np.uint64))

    return run


def tiles(keys: DataFrame, node: str, weight: str | None = None) -> DataFrame:
    """(key, low, high, node) of the keys that several nodes share; many nodes are dealt into sides of about TILE, and each
    pair of sides is a tile, so that no group, however large, meets in one task. With a column of weights (shingles) a side
    also has about LOAD of them at most."""
    load = F.sum(weight) / LOAD if weight else F.lit(0.0)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / TILE, load)).cast("long").alias("sides")).filter("n > 1")
    held = keys.join(sizes, "key")
    own = F.pmod(F.xxhash64(node, F.lit(11)), F.col("sides"))
    tiled = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    return tiled.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("n", "sides", "own", "other")


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges (a, b) whose components are those of all links of at most distance bits."""
    keys = prints.select("fp").mapInArrow(_keys(distance), "key long, fp long")
    tiled = tiles(keys, "fp")
    tiled = tiled.select("key", "low", "high", "fp")
    return tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_linked(distance), "a long, b long")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the smallest id reachable over links) of every row.

    A text of fewer words than a shingle is one shingle; a null or empty text has fingerprint zero, linked
    like any other. Rows repeat as they do in the input; ids that repeat with different texts keep a row
    each. Null ids are kept and are never a component's id unless it has no other (then null). An empty
    table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(fingerprints(texts_of(batch), words))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = pinned(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long"))
    nodes = pinned(prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(links(nodes, distance))
    linked = found.withColumnRenamed("node", "fp").join(nodes, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = pinned(linked.join(least, "root").select("fp", "least"))
    classes = pinned(nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return prints.join(classes, "fp", "left").select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: Bins of a shingle sketch, join keys of it, bits beyond which fingerprints tell texts of the wanted similarity apart, and how
#: far below the wanted similarity a sketch must be to discard (six standard errors of 256 bins).
BINS, KEYS, FAR, MARGIN = 256, 8, 28, 0.15


def hashes(found: list[bytes], words: int) -> np.ndarray:
    """The distinct XXH64 of the word shingles of a text, ascending."""
    from xxhash import xxh64_digest

    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    cuts = zip([0, *ends], ends[words - 1 :]) if len(found) > words else [(0, len(joined) + 1)] if found else []
    return np.unique(np.frombuffer(b"".join([xxh64_digest(joined[a : b - 1], SEED) for a, b in cuts]), ">u8").astype(np.uint64))


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def digest(text: str) -> bytes:
    """128-bit name of a text's words."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(_split(text)))


def sketch(text: str, words: int) -> tuple[bytes, int, bytes, np.ndarray]:
    """Of a text's distinct word shingles: 128-bit digest of its words, SimHash, least hash of each bin (two bytes of it; empty bins 0), and keys."""
    from xxhash import xxh3_128_digest

    found = _split(text)
    name = xxh3_128_digest(b" ".join(found))
    if not found:
        return name, 0, bytes(2 * BINS), np.zeros(KEYS, np.uint64)
    hashed = hashes(found, words)
    raw = hashed.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(raw), 65536):
        ones += np.unpackbits(raw[a : a + 65536], axis=1).sum(0, dtype=np.int64)
    fp = int(np.packbits(2 * ones > len(raw)).view(">u8")[0])
    bins = (hashed & np.uint64(BINS - 1)).astype(np.int64)
    order = np.argsort(bins, kind="stable")  # hashes ascend, so a bin's first is its least
    first = order[np.append(True, np.diff(bins[order]) > 0)]
    least = np.zeros(BINS, np.uint64)
    least[bins[first]] = hashed[first]
    low = ((least >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)
    short = np.where(least > 0, np.maximum(low, 1), 0).astype(np.uint16)
    groups = np.where(least > 0, least, np.uint64(2**64 - 1)).reshape(KEYS, -1).min(1)
    keys = (groups ^ (np.arange(KEYS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return name, fp, short.tobytes(), np.where(groups < np.uint64(2**64 - 1), keys | np.uint64(1), np.uint64(0))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of the shingle sets of sketches: bins that agree among those that either fills."""
    either = ((a > 0) | (b > 0)).sum(-1)
    return ((a == b) & (a > 0)).sum(-1) / np.maximum(either, 1)


def common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of the other sets (ascending, not empty) shares with one."""
    ends = np.cumsum([len(o) for o in others])
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), ends - [len(o) for o in others])


def same_enough(own: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether the shingle sets' exact similarity is at least that wanted."""
    out, start = np.zeros(len(others), bool), 0
    sizes = np.array([len(o) for o in others], np.int64)
    while start < len(others):  # about a million members at a time
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 1 << 20, side="right")))
        both = common(own, others[start:stop])
        out[start:stop] = both / (len(own) + sizes[start:stop] - both) >= similarity
        start = stop
    return out


def _similar(similarity: float, exact: bool = False):
    """Rows of tiles (node, fp, sketch) -> edges between texts that may have that similarity, by sketches with a margin;
    exact: rows have their shingle sets as well, and edges are those of at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(3)
        for tile, (node, fp, marks, *sets) in whole_groups(batches):
            fp, names = fp.to_numpy().view(np.uint64), node.to_pylist()
            marks = np.frombuffer(b"".join(marks.to_pylist()), np.uint16).reshape(-1, BINS)
            members = lambda k: np.frombuffer(sets[0][int(k)].as_buffer(), np.uint64)
            a, b = [], []
            for s, n in zip(*bounds(tile)):
                # discard by the largest coordinate difference, by bits, then by sketches; what is left may be verified
                where, left = t.distances(fp[s : s + n]), np.arange(n)
                while len(left) > 1:
                    queue, left = [left[0]], left[1:]
                    while queue and len(left):
                        x = queue.pop()
                        near = np.flatnonzero((np.abs(where[left] - where[x]) <= FAR).all(1))
                        near = near[np.bitwise_count(fp[s + left[near]] ^ fp[s + x]) <= FAR]
                        near = near[alike(marks[s + left[near]], marks[s + x]) >= similarity - MARGIN]
                        if exact and len(near):
                            near = near[same_enough(members(s + x), [members(s + k) for k in left[near]], similarity)]
                        if len(near):
                            a += [names[s + k] for k in left[near]]
                            b += [names[s + x]] * len(near)
                            queue += left[near].tolist()
                            left = np.delete(left, near)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _tiled_edges(keys: DataFrame, nodes: DataFrame, similarity: float, exact: bool = False) -> DataFrame:
    columns = ["node", "fp", "marks", *(["shingles"] if exact else [])]
    tiled = tiles(keys, "node", "weight" if exact else None).join(nodes.select(*columns), "node").select("key", "low", "high", *columns)
    return tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_similar(similarity, exact), "a binary, b binary")


def _sets(words: int):
    """Rows (node, text) -> (node, shingles): the text's shingle hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [hashes(_split(t), words).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["node", "shingles"])

    return run


def named(docs: DataFrame, column: str, text_col: str = "text") -> DataFrame:
    """The rows with the digest of their words."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            names = pa.array([digest(t or "") for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], [*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(column, BinaryType())]))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and class_id (the smallest id of the texts linked to it) of every row, by word shingles; see classes()."""
    return classes(docs, words, similarity, id_col, text_col).select(F.col("id").alias(id_col), "class_id")


def classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, node (digest of the words), class_id and class_node of every row: a class is named by its smallest id and, of the
    texts with that id, the smallest digest.

    Texts of the same words are one node. Others meet if the least hash of one of eight parts of their shingle
    sets is the same (a pair of long texts of similarity 0.8 is missed once in 400,000). Their fingerprints' pivot
    distances and bits, and sketches of 256 bins with a margin of MARGIN, discard the unlike; the shingle sets of what is
    left are compared whole, and only pairs of at least the similarity are linked. Null and empty texts are copies of
    each other; null ids have the class of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, prints, marks, keys = zip(*[sketch(t, words) for t in texts_of(batch)])
            columns = [batch.column(0), pa.array(names, pa.binary()), _signed(np.array(prints, np.uint64)), pa.array(marks, pa.binary())]
            flat = _signed(np.concatenate(keys))
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * KEYS), flat))
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "fp", "marks", "keys"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = staged(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, node binary, fp long, marks binary, keys array<long>"))
    nodes = staged(prints.groupBy("node").agg(F.min("id").alias("first"), F.min("fp").alias("fp"), F.min("marks").alias("marks"), F.min("keys").alias("keys")))
    keys = nodes.select("node", F.explode("keys").alias("key")).filter("key <> 0")
    maybe = pinned(components(_tiled_edges(keys, nodes, similarity)))
    # the sets of the texts that may be alike, once each, from one row of each text
    one = nodes.select("node", "first").join(maybe, "node", "left_semi")
    texts = named(rows, "node").select("id", "node", "text").alias("t").join(one.alias("o"), (F.col("t.node") == F.col("o.node")) & F.col("t.id").eqNullSafe(F.col("o.first")), "left_semi")
    sets = staged(texts.select("node", "text").mapInArrow(_sets(words), "node binary, shingles binary").dropDuplicates(["node"]))
    # members of a small class meet at its root, those of a large one by their keys again
    weighed = sets.select("node", (F.octet_length("shingles") / 8).alias("weight")).join(maybe, "node")
    sizes = maybe.groupBy("root").agg(F.count("*").alias("members"))
    weighed = weighed.join(sizes, "root")
    small = weighed.filter(F.col("members") <= TILE).select("node", F.xxhash64("root").alias("key"), "weight")
    large = weighed.filter(F.col("members") > TILE).join(keys, "node").select("node", "key", "weight")
    found = components(_tiled_edges(small.unionByName(large), nodes.join(sets, "node"), similarity, exact=True))
    # the row that a class is named by; null ids never name one that has others
    firsts = nodes.select("node", F.when(F.col("first").isNotNull(), F.struct("first", "node")).alias("name"))
    linked = found.join(firsts, "node")
    least = linked.groupBy("root").agg(F.min("name").alias("least"))
    by_node = linked.join(least, "root").select("node", "least")
    by = pinned(firsts.join(by_node, "node", "left").select("node", F.coalesce("least", "name").alias("name")))
    return prints.select("id", "node").join(by, "node", "left").select("id", "node", F.col("name.first").alias("class_id"), F.col("name.node").alias("class_node"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without near copies: of each class the row that names it stays, once. A row is its id and the words of its
    text: of different texts with one id each stays or goes with its own class. Rows without id stay."""
    rows = pinned(classes(docs, words, similarity, id_col, text_col).filter(F.col("id").isNotNull()))
    gone = rows.filter((F.col("id") != F.col("class_id")) | (F.col("node") != F.col("class_node"))).select(F.col("id").alias("__gone"), F.col("node").alias("__text")).distinct()
    own = named(docs, "__node", text_col)
    kept = own.join(gone, (own[id_col] == gone["__gone"]) & (own["__node"] == gone["__text"]), "left_anti")
    if rows.groupBy("id", "node").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        with_id = kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, "__node"])
        kept = with_id.unionByName(kept.filter(F.col(id_col).isNull()))
    return kept.drop("__node")
