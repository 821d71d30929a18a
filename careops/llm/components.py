"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops.llm.common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on pairs ``u > v``.

    Large star: every larger neighbour of a node is linked to the smallest of
    the node and its neighbours.  Small star: every smaller neighbour (and
    the node) is.  The smallest neighbour is a grouped minimum (combined
    before the shuffle) joined back to the pairs, so a node with very many
    links never forms one group in one task.
    """
    if large:
        arcs = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
            edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        arcs = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = arcs.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    joined = arcs.join(least, "x")
    if large:
        linked = joined.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("y").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return linked.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its smallest node.

    Every step is written with ``checkpoint`` (shared folder); only its row
    count and checksum reach the driver.  Nodes without links do not appear.
    No links give an empty result.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    state, seen = checkpoint(pairs), None
    while True:
        state = checkpoint(_star(_star(state, True), False))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    leaves = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
