"""Connected components over a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Link every neighbour of a node to the smallest of its neighbours and itself.

    The minimum is a partial aggregate joined back, so a node with very many links is never gathered in one task.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not smaller_only:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if smaller_only:
        # each u keeps its smaller neighbours v and itself, all hung on m
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) -> (node, component): the smallest node reachable, for every node that has a link.

    Large-star and small-star rounds alternate until nothing changes; each round is written to the shared folder.
    Self links, repeated links and null ends have no effect. An empty table gives an empty table.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, smaller_only=False), smaller_only=True))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        was = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
