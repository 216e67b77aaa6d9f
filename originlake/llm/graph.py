"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlake.llm.text import cut, drop


def _forest(edges: DataFrame) -> bool:
    """Whether each node of distinct edges has one parent, so that the edges are trees."""
    rows, nodes = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count(F.lit(1))).first()
    return (rows or 0) == nodes


def _step(now: DataFrame) -> DataFrame:
    """A large-star and a small-star step. Large-star edges are made twice, which costs less than to write them."""
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = cut(large.groupBy("a").agg(F.min("b").alias("m")))
    small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    drop(now, least, down)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of ids to (node, label): label is the smallest id that the node reaches.

    Each step is an aggregation with partial sums and a join of written tables,
    whose skewed keys the planner can split; no node's neighbours meet in one
    place. Lineage is cut at every step. Once every node has a single parent, the
    edges are trees whose parents are smaller, so their smallest node is the root:
    parents then become parents' parents until all are roots.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _forest(now):
        now = _step(now)
    moved = True
    while moved:
        up = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        far = cut(now.select("a", "b").join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
        drop(now)
        now, moved = far, far.where("moved").limit(1).count() > 0
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    out = cut(pairs.unionByName(roots))
    drop(now)
    return out
