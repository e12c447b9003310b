"""Connected components of a graph of long ids, by alternating stars.

Each round relinks every node to the smallest of its neighbourhood: first its
larger neighbours (large star), then its smaller ones (small star). A node's
smallest neighbour is found by an aggregate, which combines before the
shuffle, and joined back to its edges. In that join a node with more than a
ten-thousandth of all edges is dealt over as many parts as its edges need, so
a hub is never gathered in one task. The edges are checkpointed in the shared
folder in each round; the rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, heavy_keys, spread_join


def _star(edges: DataFrame, total: int) -> DataFrame:
    """One large and one small star over edges (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # Large star: larger neighbours w of u are linked to the least of u's neighbourhood.
    upward = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    large = spread_join(upward, least, ["u"], heavy_keys(upward, ["u"], total)).select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    # Small star: u and its smaller neighbours are linked to the least of these.
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
    # A node has no more smaller neighbours now than before, so the edges' heavy keys cover those of the large star.
    return spread_join(large, low, ["u"], heavy_keys(edges, ["u"], total)).select(ends).select("e.u", "e.v").filter("u > v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (two long columns a, b); the component is its smallest node.

    Nulls and loops are dropped; nodes without an edge don't appear.
    """
    at = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    at = durable(at)
    mark = _mark(at)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        at = durable(_star(at, mark[0]))
        now = _mark(at)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges: equal marks, no change."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return (r[0], r[1])
