"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of links the smallest node that it can reach.

    Each round is two shuffled joins of links with the least neighbour of their ends; no node's neighbours are ever
    gathered in a row or in the driver. Rounds end when the links are stars around their least node. Nodes may be
    numbers or strings of one kind; links with a null end or equal ends say nothing.
    """
    edges = written(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col("u") < F.col("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node is linked to the node's least neighbour (or itself)
        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").filter(F.col("u") < F.col("v")).distinct()
        # small star: every smaller neighbour of a node, and the node, are linked to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        with_low = large.join(low, "v")
        small = with_low.select(F.col("m").alias("u"), F.col("u").alias("v")).union(with_low.select(F.col("m").alias("u"), F.col("v"))).filter(F.col("u") < F.col("v")).distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
