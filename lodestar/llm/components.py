"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import written


def _largest_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _largest_first(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, hang on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _largest_first(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v), the component being its smallest node.

    Alternating large-star and small-star: both keep the components and end, after about log^2 of the size
    rounds, at edges from every node to its smallest. Each round is written to the shared folder, which
    cuts the lineage. Neighbourhoods are only ever reduced to their minimum by partial aggregation
    and joined back by equi-joins that can be split, so a node with very many neighbours is no single task.
    """
    now, mark = written(_largest_first(edges.select("u", "v")), "edges"), None
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = seen
