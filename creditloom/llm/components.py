"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in ``links`` (a, b: bigint).

    Each round hangs nodes on the smallest of their neighbours, which at least halves long paths; a node with very many
    links is an aggregation, never a list. Rounds end when the links stay the same; they are tables in the shared folder.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct()
            )
        before = state
        edges = written(star(star(edges, large=True), large=False), "links")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """u > v. A large star hangs the larger neighbours of each node on its smallest one, a small star the smaller ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("_u"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()
