"""Connected components of a graph of any size, by alternating stars.

Each round joins every node's larger neighbours to its smallest one, then its smaller
neighbours to the smallest of them; the number of rounds grows with the logarithm of the
longest path. Edges land in the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, skew_join


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return skew_join(both, least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = skew_join(edges, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have an edge to another; root is the smallest node.

    ``edges``: (a, b) BIGINT, in any order and number.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = land(edges, "edges"), None
    while True:
        facts = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(facts) == before or not facts[0]:
            break
        before = tuple(facts)
        edges = land(_small(_large(edges)), "edges")
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own)
