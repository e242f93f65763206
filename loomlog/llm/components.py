"""Connected components of a graph whose edges are a table, by alternating large-star and small-star steps.

Each step is an aggregation (the least neighbour of each node, pre-aggregated before its shuffle) and a join of two
written tables, which Spark can split where a node has very many edges. Nothing is collected but a count and a hash a
round, by which the end is seen; the number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import written


def _least(pairs: DataFrame) -> DataFrame:
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least").select(F.col("u").alias("_u"), F.least("_u", "m").alias("m"))


def _star(pairs: DataFrame, keep_all: bool) -> DataFrame:
    """``pairs`` (u, v): every v is linked to u's least neighbour instead of to u. ``keep_all``: with u itself too."""
    least = _least(pairs)
    moved = pairs.join(least, pairs["u"] == least["_u"])
    linked = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep_all:
        linked = linked.unionByName(least.where(F.col("_u") != F.col("m")).select(F.col("_u").alias("a"), F.col("m").alias("b")))
    return written(linked.distinct(), "star")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (``a``, ``b``, of an orderable type, no nulls) to ``node, root``: the least node of each node's
    component, for every node but the roots."""
    edges = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = _least(both)
        moved = both.join(least, both["u"] == least["_u"]).where(F.col("v") > F.col("u"))
        large = written(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        edges = _star(large, keep_all=True)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")
