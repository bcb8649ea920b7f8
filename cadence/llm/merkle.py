"""Merkle manifest of a table: a tree per group (source) and one over the groups' roots.

Leaves are numbered within their group by one range sort, so a hot group is cut like any other. Aligned
blocks of fanout^DEPTH consecutive nodes are numpy matrices of digests, 64 hex bytes a row: a level is
the rows reshaped by the fanout and hashed, a node's siblings are its run without its own row. Block roots
are the nodes of the next, BLOCK times smaller table, until every group has one. Going down again, what
lies above a block (the siblings of its ancestors) leads the block's rows as one row, so no row carries
more than its own digest through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadence.llm._common import fold, pinned
from cadence.llm.simhash import bounds

#: Children of a node, levels that a block holds and nodes of a block; upper case and its lower case.
FANOUT, DEPTH = 16, 2
BLOCK = FANOUT**DEPTH
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEX = 64


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field is ``-`` if null, else its UTF-8 length, a colon and its value."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows with ``pos``, their place from 0 within the group by the order (nulls first), and ``n``, the group's size.

    One range sort; the places within a partition are counted as the sorted rows stream by, and a partition's
    first place in a group follows from the counts of the partitions before it.
    """
    at = rows.columns.index(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(at)
            # runs of equal groups: rows are sorted by it
            codes = names.dictionary_encode("encode")
            ids = codes.indices.to_numpy()
            cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            size = np.diff(np.append(cut, len(ids)))
            place = np.arange(len(ids), dtype=np.int64) - np.repeat(cut, size)
            first = (names[0].as_py(),)
            if first == last:
                place[: size[0]] += seen
            last, seen = (names[len(ids) - 1].as_py(),), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"])

    # equal rows may stand in any order: a drawn number spreads them over the ranges
    keys = [F.col(group), *[F.col(c) for c in order], F.col("__salt")]
    ranged = rows.withColumn("__salt", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__salt")
    schema = T.StructType([*rows.schema, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    held = pinned(ranged.mapInArrow(count, schema))
    sizes = held.groupBy(group, "part").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("__g"), F.col("part").alias("__p"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"), F.sum("__c").over(Window.partitionBy(group)).alias("n"))
    joined = held.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("part") == F.col("__p")))
    return joined.select(*rows.columns, (F.col("place") + F.col("__start")).alias("pos"), "n")


def _digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def matrix(digests: list[bytes]) -> np.ndarray:
    """The digests as one contiguous matrix, a row each."""
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, HEX)


def raise_block(nodes: np.ndarray, total: int) -> list[np.ndarray]:
    """The levels of an aligned block from its nodes up, of a group with that many nodes at the block's level: DEPTH above
    the nodes, or as many as it takes until the group has one node."""
    levels = [nodes]
    while len(levels) <= DEPTH and total > 1:
        below, total = levels[-1], -(-total // FANOUT)
        whole = len(below) // FANOUT
        runs = below[: whole * FANOUT].reshape(whole, FANOUT * HEX)
        made = [_digest(row.tobytes()) for row in runs]
        if whole * FANOUT < len(below):
            made.append(_digest(below[whole * FANOUT :].tobytes()))
        levels.append(matrix(made))
    return levels


def siblings(levels: list[np.ndarray], k: int) -> list[tuple[int, bytes]]:
    """Level by level the place of a block's k-th node (or of its ancestor) within its run, and the run's other digests."""
    path = []
    for nodes in levels[:-1]:
        start, place = k - k % FANOUT, k % FANOUT
        run = nodes[start : start + FANOUT].tobytes()
        path.append((place, run[: place * HEX] + run[(place + 1) * HEX :]))
        k //= FANOUT
    return path


def climb(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a digest and its path lead to."""
    for place, others in path:
        node = _digest(others[: place * HEX] + node + others[place * HEX :])
    return node


def _blocks(nodes: DataFrame, group: str) -> DataFrame:
    """The rows of a block side by side and in order."""
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).repartition(group, "block").sortWithinPartitions(group, "block", "pos")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Sorted rows (group, block, …) -> one table a block; only the rows of one Arrow batch and one block are held."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        cuts, sizes = bounds(np.stack([codes, batch.column(1).to_numpy().astype(np.int64)], 1))
        for a, size in zip(cuts.tolist(), sizes.tolist()):
            own = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
            if held and own != name:
                yield held
                held = []
            name = own
            held.append(batch.slice(a, size))
    if held:
        yield held


def _raise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, block, n, digest) of blocks -> (group, block, n of the next level, root of the block)."""
    out: list[list] = [[], [], [], []]
    kind = None
    for rows in _parts(batches):
        kind = rows[0].column(0).type
        total = rows[0].column(2)[0].as_py()
        digests = [d.encode() for r in rows for d in r.column(3).to_pylist()]
        root = raise_block(matrix(digests), total)[-1]
        for column, value in zip(out, (rows[0].column(0)[0].as_py(), rows[0].column(1)[0].as_py(), -(-total // BLOCK), root.tobytes().decode())):
            column.append(value)
        if len(out[0]) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3])], ["group", "pos", "n", "digest"])
            out = [[], [], [], []]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3])], ["group", "pos", "n", "digest"])


def _lead(above: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of a level, each block led by a row (pos -1) with the path above it; blocks side by side."""
    led = above.select("group", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "places", "others")
    rows = below.withColumn("block", F.floor(F.col("pos") / BLOCK)).unionByName(led, allowMissingColumns=True)
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", "pos")


def _paths(rows: list[pa.RecordBatch], digests: int, places: int) -> tuple[list[np.ndarray], list[tuple[int, bytes]]]:
    """A block led by its path -> its levels and that path."""
    first = rows[0].slice(0, 1)
    above, at = first.column(places)[0].as_py() or [], first.column(places + 1)[0].as_py() or b""
    path, start = [], 0
    for place, count in zip(above[::2], above[1::2]):
        path.append((place, at[start : start + count * HEX]))
        start += count * HEX
    nodes = matrix([d.encode() for r in rows for d in r.column(digests).to_pylist() if d is not None])
    return nodes, path


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Led rows (group, block, pos, n, digest, places, others) -> (group, pos, places, others): every node's path to its group's top."""
    for rows in _parts(batches):
        nodes, above = _paths(rows, 4, 5)
        total = rows[-1].column(3)[rows[-1].num_rows - 1].as_py()
        levels, start = raise_block(nodes, total), rows[0].column(1)[0].as_py() * BLOCK
        found = [siblings(levels, k) + above for k in range(len(nodes))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[0].column(0)[0].as_py()] * len(found), rows[0].column(0).type),
                pa.array(np.arange(start, start + len(found), dtype=np.int64)),
                pa.array([[x for place, others in path for x in (place, len(others) // HEX)] for path in found], pa.list_(pa.int32())),
                pa.array([b"".join(others for _, others in path) for path in found], pa.binary()),
            ],
            ["group", "pos", "places", "others"],
        )


def _tops(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (group, pos, n, digest) and the block roots above them, level by level, until every group has one."""
    kind = nodes.schema["group"].dataType.simpleString()
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = _blocks(levels[-1], "group").select("group", "block", "n", "digest")
        levels.append(pinned(blocks.mapInArrow(_raise, f"group {kind}, pos long, n long, digest string")))
    return levels


def _down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The paths (group, pos, places, others) of the nodes of the lowest of the levels, top those of the highest's."""
    kind = top.schema["group"].dataType.simpleString()
    paths = top
    for nodes in levels[-2::-1]:
        led = _lead(paths, nodes).select("group", "block", "pos", "n", "digest", "places", "others")
        paths = pinned(led.mapInArrow(_lower, f"group {kind}, pos long, places array<int>, others binary"))
    return paths


def _proofs(root: str):
    """Led rows (group, block, pos, n, leaf, places, others, changed, id) -> a row a leaf; the led row has subroot in leaf's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            subroot = rows[0].column(9)[0].as_py()
            nodes, above = _paths(rows, 4, 5)
            total = rows[-1].column(3)[rows[-1].num_rows - 1].as_py()
            levels = raise_block(nodes, total)
            table = pa.Table.from_batches(rows).slice(1)
            digests, folded = [], []
            for k, (own, now) in enumerate(zip(table.column(4).to_pylist(), table.column(7).to_pylist())):
                path = siblings(levels, k) + above
                digests.append(sha256(b"".join(others for _, others in path)).hexdigest())
                folded.append(climb((now or own).encode(), path).decode())
            n = len(digests)
            columns = [table.column(8), table.column(4), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(digests, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())]
            yield from pa.table(columns, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).combine_chunks().to_batches()

    return run


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", id_col: str = "doc_id") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of a table.

    Leaves of a group stand by id (null first, ids that repeat by their leaf); groups by name, the null group first. A
    group of one leaf is that leaf, a table of one group has the group's root. ``docs`` may have a column ``__now``,
    the leaf as it is now; where that is null or there is none, a leaf is as it was and verifies. Rows repeat as they do in the
    input, an empty table gives none; columns other than the fields and ``__now`` are not read.
    """
    now = F.col("__now") if "__now" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(group).cast("string").alias("group"), F.col(id_col).alias("id"), leaf(*[F.col(c) for c in fields]).alias("digest"), now.alias("now"))
    leaves = pinned(numbered(rows, "group", "id", "digest"))
    levels = _tops(leaves.select("group", "pos", "n", "digest"))
    subroots = levels[-1].select("group", "digest")
    # the tree over the groups: one group of its own
    named = numbered(subroots.select(F.lit(0).alias("all"), F.col("group").alias("name"), "digest"), "all", "name").select(F.col("all").alias("group"), "name", "pos", "n", "digest")
    named = pinned(named)
    tops = _tops(named.select("group", "pos", "n", "digest"))
    first = tops[-1].select("digest").first()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if first is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    none = [F.expr("cast(array() as array<int>)").alias("places"), F.lit(b"").alias("others")]
    over = _down(tops, tops[-1].select("group", "pos", *none))
    top = named.join(over, ["group", "pos"]).select(F.col("name").alias("group"), F.lit(0).cast("long").alias("pos"), "places", "others", F.col("digest").alias("subroot"))
    top = pinned(top)
    if len(levels) == 1:  # no group has two leaves
        above = top
    else:
        above = _down(levels[1:], top.drop("subroot"))
        above = above.join(top.select(F.col("group").alias("__g"), "subroot"), F.col("group").eqNullSafe(F.col("__g"))).drop("__g")
    led = above.select("group", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "places", "others", "subroot")
    whole = leaves.withColumn("block", F.floor(F.col("pos") / BLOCK)).unionByName(led, allowMissingColumns=True)
    whole = whole.repartition("group", "block").sortWithinPartitions("group", "block", "pos")
    whole = whole.select("group", "block", "pos", "n", "digest", "places", "others", "now", "id", "subroot")
    return whole.mapInArrow(_proofs(first[0]), schema).withColumnRenamed("id", id_col)


def tampered(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``__now``: where 5 divides the id's crc32 the leaf of the row with its text's A-Z lower-cased, else null."""
    lowered = leaf(*[F.translate(text_col, UPPER, LOWER) if c == text_col else F.col(c) for c in fields])
    return docs.withColumn("__now", F.when(fold(F.col(id_col), 5) == 0, lowered))


def oracle(levels: int = 5) -> str:
    """DuckDB's SQL for op13 over groups of at most FANOUT^levels leaves and as many groups: levels are unrolled."""
    part = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf_of = lambda text: "sha256(concat(" + ", ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    # crc32 by its table: eight halvings make an entry, a byte of the id is one step
    ctes = [
        "made0 as (select i, cast(i as bigint) as v from range(256) t(i))",
        *[f"made{k + 1} as (select i, case when v & 1 = 1 then xor(3988292384, v >> 1) else v >> 1 end as v from made{k})" for k in range(8)],
        "crc as (select list(v order by i) as t from made8)",
        f"""base as (select doc_id, source, {leaf_of("text")} as leaf, {leaf_of(f"translate(text, '{UPPER}', '{LOWER}')")} as low,
            xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
            lambda a, b: xor(a >> 8, crc.t[cast(xor(a, b) & 255 as integer) + 1]))) as crc from documents, crc)""",
        "l0 as (select source as g, row_number() over (partition by source order by doc_id, leaf) - 1 as pos, count(*) over (partition by source) as n, leaf as d, doc_id, case when crc % 5 = 0 then low else leaf end as now from base)",
    ]

    def tree(p: str) -> None:
        for k in range(levels):
            ctes.append(
                f"""{p}{k + 1} as (select g, pos // {FANOUT} as pos, max(n + {FANOUT - 1}) // {FANOUT} as n, case when max(n) > 1 then sha256(string_agg(d, '' order by pos)) else max(d) end as d
                from {p}{k} group by g, pos // {FANOUT})"""
            )

    tree("l")
    ctes.append(f"t0 as (select 0 as g, row_number() over (order by g nulls first) - 1 as pos, count(*) over () as n, d, g as name from l{levels})")
    tree("t")

    def up(prefix: str, first: str, source: str, keys: str) -> str:
        """Goes level by level through a tree: own digest, folded digest and the siblings gathered so far."""
        last = source
        for k in range(levels):
            name = f"{first}{k + 1}"
            ctes.append(
                f"""{name}r as (select g, pos // {FANOUT} as run, list(d order by pos) as ds, max(n) as n from {prefix}{k} group by g, pos // {FANOUT})"""
            )
            ctes.append(
                f"""{name} as (select x.* exclude (p, f, sib), x.p // {FANOUT} as p,
                case when r.n > 1 then sha256(array_to_string(list_concat(list_concat(r.ds[:x.p % {FANOUT}], [x.f]), r.ds[x.p % {FANOUT} + 2:]), '')) else x.f end as f,
                case when r.n > 1 then x.sib || array_to_string(list_concat(r.ds[:x.p % {FANOUT}], r.ds[x.p % {FANOUT} + 2:]), '') else x.sib end as sib
                from {last} x join {name}r r on {keys} and r.run = x.p // {FANOUT})"""
            )
            last = name
        return last

    ctes.append("u0 as (select doc_id, g, d as leaf, pos as p, now as f, '' as sib from l0)")
    inside = up("l", "u", "u0", "r.g is not distinct from x.g")
    ctes.append(f"v0 as (select x.doc_id, x.leaf, s.d as subroot, s.pos as p, x.f, x.sib from {inside} x join t0 s on s.name is not distinct from x.g)")
    over = up("t", "v", "v0", "true")
    return f"with {', '.join(ctes)} select x.doc_id, x.leaf, x.subroot, t.d as root, sha256(x.sib) as proof_sha256, x.f as folded_root, x.f = t.d as verified from {over} x, t{levels} t"
