"""Connected components of an undirected graph, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import checkpointed


def _with_least(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``edges`` with the least of u and its neighbours v. The minimum is combined before the shuffle and joined back,
    so that Spark can split a node with very many neighbours."""
    least = edges.groupBy(F.col(u).alias("of")).agg(F.min(v).alias("least"))
    return edges.join(least, edges[u] == least["of"]).select(u, v, F.least("least", u).alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (u, v); the component is its smallest node.

    Each round hangs nodes below smaller neighbours (first the larger ones, then the smaller ones) until only stars are
    left; the number of rounds grows with the logarithm of the longest chain. Every round is checkpointed. Edges with a
    null end and loops are ignored; repeated edges count once.
    """
    flat = edges.select("u", "v").filter("u is not null and v is not null and u <> v")
    edges = checkpointed(flat.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.filter("u > v").distinct()
        small = _with_least(large, "u", "v")
        hung = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionAll(small.select("u", F.col("least").alias("v")))
        edges = checkpointed(hung.filter("u > v").distinct())
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
