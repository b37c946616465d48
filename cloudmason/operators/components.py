"""Connected components of graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudmason.session import cut


def join_labels(links: DataFrame) -> DataFrame:
    """node, head: the smallest node of each node's component, from links a, b; alternating large and small stars.

    Every round is a shuffle with pre-aggregation whose result is written to the checkpoint folder, so the plan stays
    short and lost executors cost one round. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v"))
        nxt = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = _mark(nxt)
        if now == mark:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("head"))
        edges, mark = nxt, now


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free hashes: equal marks mean that a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
