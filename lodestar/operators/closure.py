"""Relations inferred from listed ones: containment through several levels, neighbours both ways, and pairs that are neither."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.scratch import stored


def transitive(edges: DataFrame) -> DataFrame:
    """(a, b, steps) for every b that is reached from a by the edges (a, b), with the least number of steps.

    Semi-naive: each round joins only the pairs found in the last one with the edges and takes off those that are known, so the work is that of
    the result, and cycles end. Each round is stored, which cuts the lineage; there are as many rounds as the longest shortest chain. Null
    ends are left out; repeated edges count once.
    """
    edges = stored(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    found = new = stored(edges.withColumn("steps", F.lit(1)), "reached")
    onward = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    while True:
        next_ = new.join(onward, "b").select("a", F.col("c").alias("b"), (F.col("steps") + 1).alias("steps")).distinct()
        new = stored(next_.join(found.select("a", "b"), ["a", "b"], "left_anti"), "reached")
        if new.isEmpty():
            return found
        found = found.union(new)


def neighbours(listed: DataFrame) -> DataFrame:
    """(a, b) both ways for every listed pair, once, without pairs of an entity with itself."""
    both = listed.select("a", "b").union(listed.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a <> b").distinct()


def siblings_apart(parents: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(parent, a, b), a < b, of the children (parent, child) of one parent that are not adjacent (a, b): the pairs that can be called
    disjoint, since their parts of the parent do not overlap. The output is the pairs of each parent's children; lists of children are short."""
    one, two = (parents.select("parent", F.col("child").alias(c)).distinct() for c in "ab")
    return one.join(two, "parent").where("a < b").join(adjacent, ["a", "b"], "left_anti").select("parent", "a", "b")
