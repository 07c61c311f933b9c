"""Connected components by alternating large and small stars, on written edge tables.

Every round is two aggregations and two joins; nothing is collected per node, so a star with a
third of all edges is a partial minimum and a join that the engine may split. Rounds end when all
edges form stars around the smallest nodes, which takes about the logarithm of the longest chain.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import base


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v, without repeats. Large: neighbours above u go to the least neighbour; small: those below, and u."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _stars(pairs: DataFrame) -> bool:
    """Every node has one edge, to a node that has none itself."""
    n, nodes = pairs.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def label(edges: DataFrame, work: str) -> DataFrame:
    """(node, label) with label = smallest reachable node, for nodes that have an edge to another node."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    pairs, k = base.materialize(pairs, f"{work}/edges_0"), 0
    while not _stars(pairs):
        k += 1
        big = base.materialize(_star(pairs, True), f"{work}/large_{k}")
        pairs = base.materialize(_star(big, False), f"{work}/edges_{k}")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
