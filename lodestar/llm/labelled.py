"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bucket_of


def training_labels(labels: DataFrame, id_col: str, label_col: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(id, y) of at most `rows` labelled ids outside the held-out fold, in hash order; one row per id."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    return known.where(bucket_of("id", folds) != held_out).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
