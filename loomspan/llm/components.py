"""Connected components of any graph by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges run from a larger node u to a smaller node v. Each u goes over to the smallest that v knows, v included."""
    least = edges.select(F.col("v").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y"))).groupBy("x").agg(F.min("y").alias("m"))
    return edges.join(least, edges["v"] == least["x"]).select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself go over to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.where("u != v").distinct()


def components(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of the pairs (a, b); root is the smallest node of its component.

    Each round is written to the shared folder. The smallest of a node's neighbours is found by an aggregation that
    combines before its shuffle, and comes back by a join, so a node with very many edges isn't gathered in a task.
    """
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
    before = state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = written(_small_star(_large_star(edges)))
        if (after := state(edges)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
