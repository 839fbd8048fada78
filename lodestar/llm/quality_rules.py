"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.llm.common import WS_CHARS, WS_CLASS, hash128, written
from lodestar.llm.line_dedup import line_key, split_lines


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS_CLASS}]+"))


def window_hashes(words: Column, width: int) -> Column:
    """One 64-bit hash for each window of so many words; empty if there are fewer words."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))


def repeated_words(hashes: Column, width: int) -> Column:
    """How many words lie in windows whose hash occurs twice or more in the array.

    The (hash, start) pairs are sorted; a start repeats if a neighbour has its hash; the starts
    in order then cover min(width, distance to the next start) words each.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # one-element arrays bind the intermediate arrays, so each is computed once
    starts = F.get(F.transform(F.array(pairs), twice), F.lit(0))
    return F.get(F.transform(F.array(starts), covered), F.lit(0)).cast("long")


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, width: int = 8,
    max_repeat_percent: int = 30, max_docs_per_host: int = 10, min_left_percent: int = 30,
) -> DataFrame:
    """Per-document rules, then removal of lines that recur across the documents of a host.

    A line (trimmed, A-Z lowered, holding a word) is boilerplate of its host if more than
    ``max_docs_per_host`` different documents of the host hold it; copies of a page count one each,
    rows that share an id count as one. A document of which under ``min_left_percent`` percent of the words remain
    is depleted. ``kept`` is false for documents that fail a base rule and for depleted ones.

    Returns one row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_boilerplate_words (long), base_failed, kept.

    Plan: one projection reads the texts and computes every per-document figure, with the window
    test inside the row; texts are never shuffled. Lines travel as 128-bit hashes, with the words of a text's like lines
    summed before the shuffle. Documents are counted in two steps, so one frequent line is pre-aggregated by every
    task. The frequent lines, at most a part in ``max_docs_per_host`` of all, are written; the lines meet them in an
    equi-join that adaptive execution splits or broadcasts by size.

    Cases: null text has no words and fails the base rules; a null host is a host of its own; a row with a null
    id is the same document as others without id and of equal text; repeated rows are judged like any other row, each with
    the verdict of its text; an empty table gives an empty result; further columns are ignored.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{host_col}`").cast("string").alias("host"))
    docs = docs.select("id", F.struct(F.col("host").isNull().alias("x"), F.coalesce("host", F.lit("")).alias("y")).alias("host"), "text", hash128(F.col("text")).alias("key"))

    full_lines = F.filter(split_lines(F.col("text")), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    joined = F.array_join("words", "")
    figures = (
        docs.withColumn("words", words_of(F.col("text")))
        .withColumn("hashes", window_hashes(F.col("words"), width))
        .select(
            "id", "host", "key",
            F.size("words").cast("long").alias("n_words"),
            F.char_length(joined).cast("long").alias("word_chars"),
            (F.char_length(joined) - F.char_length(F.regexp_replace(joined, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            (F.size(full_lines) - F.size(F.array_distinct(full_lines))).cast("long").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0).cast("long")).otherwise(repeated_words(F.col("hashes"), width)).alias("n_repeat_words"),
        )
    )

    lines = (
        docs.select("host", "key", F.struct("id", F.when(F.col("id").isNull(), F.col("key")).alias("key")).alias("doc"), F.explode(split_lines(F.col("text"))).alias("line"))
        .where(F.btrim("line", F.lit(WS_CHARS)) != "")
        .select("host", "key", "doc", hash128(line_key(F.col("line"))).alias("h"), F.size(F.split(F.btrim("line", F.lit(WS_CHARS)), f"[{WS_CLASS}]+")).alias("n"))
    )
    # the words of each line of each text, times the number of rows that hold the text
    held = lines.groupBy("host", "h", "key", "doc").agg(F.sum("n").alias("n"))
    counted = held.groupBy("host", "h").agg(F.count_distinct("doc").alias("docs"))
    frequent = written(counted.where(F.col("docs") > max_docs_per_host).select("host", "h"), "frequent-lines")
    removed = held.join(frequent, ["host", "h"]).groupBy("host", "key").agg(F.sum("n").alias("removed"))

    copies = figures.groupBy("host", "key").agg(F.count("*").alias("copies"))
    removed = removed.join(copies, ["host", "key"]).select("host", "key", (F.col("removed") / F.col("copies")).cast("long").alias("n_boilerplate_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_boilerplate_words")) >= min_left_percent * F.col("n_words")
    return (
        figures.join(removed, ["host", "key"], "left")
        .select(
            F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            F.coalesce("n_boilerplate_words", F.lit(0).cast("long")).alias("n_boilerplate_words"), failed.alias("base_failed"),
        )
        .withColumn("kept", ~F.col("base_failed") & left)
    )
