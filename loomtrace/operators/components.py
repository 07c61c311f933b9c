"""Connected components of an edge table, by alternating stars on written tables.

A round first hangs every larger neighbour of a node on its least neighbour, then every node and its smaller
neighbours on the least of them. Both are partial minima and joins; rounds end when each node has one edge, to a
node without one, after about the logarithm of the longest path.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtrace.plans.tables import materialize


def _hung(edges: DataFrame, up: bool) -> DataFrame:
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if up else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    far = seen.join(least, "u")
    if up:
        far = far.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        far = far.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return far.filter("u <> v").distinct()


def components(edges: DataFrame, work: str) -> DataFrame:
    """(node, label) with the least node reachable, for the nodes of edges (u, v)."""
    at = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    at, n = materialize(at, f"{work}/edges_0"), 0
    while True:
        stars = at.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] in (None, 1)
        if stars and at.join(at.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        n += 1
        at = materialize(_hung(materialize(_hung(at, True), f"{work}/up_{n}"), False), f"{work}/edges_{n}")
    leaves = at.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
