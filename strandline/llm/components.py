"""Connected components of a graph of document ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch

#: Smallest neighbours of up to so many nodes are broadcast to the edges (16 bytes each); beyond, both are shuffled.
BROADCAST_NODES = 500_000


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """edges: u, v (ids, either way round). (node, component) of every node with an edge; component is the smallest id reachable.

    Each round links the neighbours of a node to the smallest of them, by an aggregation and a join; no neighbourhood is ever gathered.
    """
    now = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    mark, k = None, 0
    state = now.agg(F.count(F.lit(1))).head()
    while True:
        # a graph has no more nodes than twice its edges; a shuffle by node would gather the edges of the largest star
        light = F.broadcast if 2 * state[0] <= BROADCAST_NODES else (lambda df: df)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(light(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.table(large, f"{name}{k}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(light(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        now = scratch.table(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        scratch.drop(f"{name}{k - 1}l")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") - F.col("v"))).head()
        if state == mark:
            break
        mark = state
    return scratch.table(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), name)
