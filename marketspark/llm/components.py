"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that tell whether a link table has changed."""
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mark).first())


def _point(pairs: DataFrame, lowest: DataFrame) -> DataFrame:
    return pairs.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _point(both.where("v > u"), lowest)


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    return _point(down, lowest).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links between whole numbers -> (node, root): root is the component's smallest node.

    Links are rewritten until every node points at its root. A node with very many links meets only
    partial minima and joins that Spark can split; nothing but two numbers reaches the driver. The
    tables of a turn are dropped after the next one.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.store(links.where("u != v").select("u", "v").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        turn = Scratch(links.sparkSession)
        between = scratch.store(_large_star(edges), "links")
        edges = turn.store(_small_star(between), "links")
        scratch.drop()  # the tables of the turn before
        scratch = turn
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
