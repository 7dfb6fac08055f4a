"""Connected components of an edge table, by alternating stars.

A large star links each node's larger neighbours to the smallest node it knows, a small
star links its smaller neighbours to it; after a few rounds every component is a star
around its smallest node. Each half is an aggregate (the smallest neighbour, combined
before the shuffle) and a join, so a node with very many neighbours needs no task that
holds them together. Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import forget, settle, split_join


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return split_join(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    # Repeated edges go at the end only: made distinct here, a node's edges would have to meet in one task.
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return split_join(down, least, ["a"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _open(links: DataFrame) -> bool:
    """Whether any node has two smaller neighbours, or a smaller and a larger one: else all are stars."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(of.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; a component is named after its smallest node.

    Null ends and loops do not count; no edges give no rows.
    """
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = settle(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while _open(links):
        if not (rounds := rounds - 1):
            raise RuntimeError("components did not settle in the rounds allowed")
        before, links = links, settle(_small(_large(links)))
        forget(before)
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
