"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pestle.llm.common import discard, written


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges have ``u > v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def flat(edges: DataFrame) -> bool:
    """Whether every node has one link, to a root: then no step changes anything."""
    sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    nodes = sides.groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return nodes.filter("child > 1 OR (child > 0 AND root > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``edges`` (``u, v``, bigint).

    Self links and repeated links do not matter; no links give no rows. Nodes' neighbours are only ever
    reduced to their minimum, so a hub needs no more memory than any node. Each round is written down,
    and the rounds end when every node is linked to its component's root and to nothing else.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not flat(now):
        before, now = now, written(small_star(large_star(now)), "links")
        discard(before)
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
