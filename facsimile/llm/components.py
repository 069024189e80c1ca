"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import store


def _stars(links: DataFrame) -> DataFrame:
    """(node, low): each node and the smallest of itself and its neighbours."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the component is its smallest node.

    A large star hangs each node's larger neighbours on the smallest of its
    neighbourhood, a small star does the same with the smaller ones. Rounds grow with
    the logarithm of the node count. Each step keeps at most one link per node and
    neighbour, so a hub's links shrink from round to round; counts, not links, reach
    the driver. Links of a node with itself count for nothing; no links, no rows.
    """
    edges = store(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        # Large star: neighbours above the node move to the lowest of its neighbourhood.
        around = _both_ways(edges)
        large = around.join(_stars(around), "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: the node and its neighbours below it move to the lowest of them.
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = large.join(lows, "a")
        small = hung.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lows.select("a", F.col("low").alias("b"))
        )
        edges = store(small.distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
