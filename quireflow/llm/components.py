"""Connected components of a table of edges, by alternating large-star and small-star steps.

Each round is a handful of shuffles over rows of two ids; a round's edges are
written to the shared folder, so nothing is collected and lost executors cost a
round at most. Minima are pre-aggregated before they are shuffled; the join that
hands them to a hub's many edges is an inner equi-join, which adaptive execution
can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select("m", "v").toDF("u", "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u != m").select(F.col("m"), F.col("u")).toDF("u", "v")
    return moved.union(least.select(F.col("m").alias("u"), "v")).distinct()


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes that keep edges u < v from being stars around their least nodes: those with several u, or with a u and a v."""
    nodes = edges.select(F.col("v").alias("node"), F.lit(1).alias("leaf")).union(edges.select("u", F.lit(0)))
    return nodes.groupBy("node").agg(F.sum("leaf").alias("above"), F.count("*").alias("n")).where((F.col("above") > 0) & (F.col("n") > 1))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least reachable node) for every node of edges (u, v). Empty edges give no rows."""
    current = shared.stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "components")
    for _ in range(max_rounds):
        if _unfinished(current).isEmpty():
            break
        current = shared.stored(_small_star(_large_star(current)), "components")
    else:
        raise RuntimeError("components did not converge")
    return current.select(F.col("v").alias("node"), F.col("u").alias("component")).union(current.select("u", "u").distinct())
