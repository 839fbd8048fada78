"""The corpus pipeline: drop toxic documents, drop shared lines, keep one of each near-duplicate group, mix the sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import line_dedup, mixing, ngram_join, packing, toxicity
from lodestar.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores under 0.5 stay, all columns as they were. Null and empty texts score the base rate of
    the labels; null and repeated ids make no difference; without labels nothing is rejected; an empty table stays empty."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold go, but for the largest document with them; n_chars follows. No document
    goes: one whose lines are all held elsewhere stays with an empty text. A null text stays null; documents without an id
    stay whole; rows that repeat an id count as one document; an empty table stays empty."""
    out = line_dedup.line_dedup(docs).select("row.*", F.col("kept").alias("__kept"))
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("__kept"))
    return out.withColumn("text", text).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of similarity 0.8 or more the one with the smallest id stays, whole.

    Null and empty texts are linked with nothing and stay; rows equal in id and text are one document; rows that repeat an id with
    another text are documents of their own; documents without an id are judged by their text like others and stay only if no
    linked one has an id; an empty table stays empty.
    """
    return ngram_join.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves the sources by the square root of their size. A null source is a source; null
    and repeated ids keep all their rows, ties stand in some order; an empty table stays empty."""
    return mixing.mixed(docs, size=F.char_length(F.coalesce("text", F.lit(""))), block=1 << 18)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, each of documents that are near each other in the mixed order; ids follow that order.
    A null text is an empty document (one end id); null and repeated ids are documents of their own; an empty table gives no row."""
    return packing.pack(docs, ordered=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot state the toxicity model or the genetic packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
