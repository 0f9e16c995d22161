"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import met, stored

#: Nodes that are broadcast with their smallest neighbours, sixteen bytes each.
BROADCAST_NODES = 500_000


def _large_star(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the node's smallest neighbour."""
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "stars")
    return met(both, least, ["a"], "inner", BROADCAST_NODES).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("low")), "stars")
    return met(down, least, ["a"], "inner", BROADCAST_NODES).select("b", "low").union(least.select("a", "low")).toDF("a", "b").filter("a != b")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, low): every linked node with the smallest node that it reaches.

    Minima are pre-aggregated and links join them by node: a broadcast while the nodes are few, else under salts, so
    the links of a node with very many of them meet in no task. Each round is written to the shared folder; rounds grow with the logarithm of the number of
    nodes, and end when the table no longer changes. Links with a null end are left out.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct()
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges)).distinct(), "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("low")).union(edges.select("b", "b").distinct())
