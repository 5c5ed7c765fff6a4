"""Connected components of links between integer nodes: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.session import materialise


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Links (a, b), a > b, moved to the least neighbour of each node.

    The least neighbours are a table of their own, so that the join that follows may split a hub's links.
    """
    if small:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = materialise(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    met = near.join(least, "u")
    if small:
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (columns a, b) that is not itself the least of its component."""
    now = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = None
    while True:
        print_ = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == print_:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = print_
        now = materialise(_stars(materialise(_stars(now, False), "large"), True), "small")
