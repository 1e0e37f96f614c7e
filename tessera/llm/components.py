"""Connected components of a link table, by alternating star contractions.

Each round hangs, for every node, its larger neighbours on the smallest node
it sees (large star), then its smaller neighbours and itself likewise (small
star). The rounds needed grow with the logarithm of the longest chain. A
minimum per node is pre-aggregated before its shuffle, and neighbours are met
by a join that Spark can split, so a node with very many links is no
bottleneck; no adjacency list is ever built and nothing but two numbers per
round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed


def _hang(pairs: DataFrame) -> DataFrame:
    """(v, m) for each pair (u, v), m the least of u and all its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """Nodes and the smallest node of their component.

    ``edges`` has columns a, b of one orderable integer type; direction,
    repeats, loops and nulls do not matter. Returns (node, root) for each node
    on an edge between two different nodes, the root itself included. An empty
    table gives an empty result.
    """
    now = _clean(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).dropna())
    now, last = checkpointed(now), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _clean(_hang(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        met = _hang(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        now = checkpointed(_clean(small.unionByName(own)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
