"""Connected components of large graphs by alternating stars, every round cut off in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import pinned


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, root), root the smallest node reachable, for every node with an edge to another.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones; a hub's
    edges are joined (which adaptive execution splits) and never collected. Only two numbers a round reach
    the driver. Self-links and repeated links are of no effect; an empty graph has no rows.
    """
    kept = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept, seen = pinned(kept), None
    for _ in range(rounds):
        state = tuple(kept.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        kept = pinned(small.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
