"""Operators on a materialised lattice: patterns (key, level, support) and edges (parent, child, canonical)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut


def maximal(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """Patterns without children."""
    return patterns.join(edges.select(F.col("parent").alias("key")), "key", "left_anti")


def canonical_leaves(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """Patterns without canonical children."""
    return maximal(patterns, edges.where("canonical"))


def degrees(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, n_children, n_parents, n_adjacent) of every pattern."""
    down = edges.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    up = edges.groupBy(F.col("child").alias("key")).agg(F.count("*").alias("n_parents"))
    joined = patterns.select("key").join(down, "key", "left").join(up, "key", "left").na.fill(0, ["n_children", "n_parents"])
    return joined.withColumn("n_adjacent", F.col("n_children") + F.col("n_parents"))


def sublattice(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(key, node): every node from which the patterns ``of`` (key) are reached, themselves included.

    Parents of the frontier, level by level; a level is one join.
    """
    frontier = cut(of.select("key", F.col("key").alias("node")).distinct())
    found = frontier
    while not frontier.isEmpty():
        up = frontier.join(edges, frontier["node"] == edges["child"]).select("key", F.col("parent").alias("node")).distinct()
        frontier = cut(up.join(found, ["key", "node"], "left_anti"))
        found = found.unionByName(frontier)
    return cut(found)


def sublattice_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, parent, child): edges of ``edges`` with both ends in the sub-lattice of key."""
    low = nodes.withColumnRenamed("node", "parent")
    high = nodes.withColumnRenamed("node", "child")
    return edges.select("parent", "child").join(low, "parent").join(high, ["key", "child"]).select("key", "parent", "child")
