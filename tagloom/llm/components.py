"""Connected components of an edge table by repeated contraction to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (a node, the same for all of a component) of every node of ``edges`` (a, b).

    In each round every node points to the smallest of itself and its neighbours, and edges are drawn
    anew between these. Nodes are hashes here, so neighbours' order is random and each round removes a share
    of the nodes of any component; a path whose nodes are numbered in order would take a round a node. Pointers and
    edges are written to the shared folder, so lineage stays short. A node of many edges is aggregated
    before the shuffle, and joins are between plain exchanges, which can be split.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(edges.select(low.alias("a"), high.alias("b")).where("a <> b").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        step = written(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")))
        if roots is None:
            roots = step.withColumnRenamed("to", "root")
        else:
            roots = written(roots.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        for side in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(side), "to"), side).drop(side).withColumnRenamed("to", side)
        edges = written(edges.select(low.alias("a"), high.alias("b")).where("a <> b").distinct())
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
