"""Line deduplication across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import WS_CHARS, ascii_lower, hash128, written


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WS_CHARS)))


def split_lines(text: Column) -> Column:
    """All \\n-separated lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drops lines that many documents hold, but for the largest document that holds them.

    Returns every input row as columns ``row`` (a struct of all input columns as they were),
    ``n_lines``, ``n_dropped`` and ``kept`` (the remaining lines joined by newlines). Keys
    shorter than ``min_chars`` code points are never dropped.

    Plan: explode the long lines to 128-bit key hashes; count the documents of each key by partial aggregation, one row per
    document and key; write the keys over the threshold, which is a small table; join the lines back to it by an equi-join
    that adaptive execution splits where one line is in very many documents, or broadcasts by size; gather the positions
    to drop of each text; take them out of the text's own line array by a hash-based set difference.

    Cases: null text counts as empty; rows with a null id are returned whole and not counted;
    rows that share an id count as one document and lose the same lines; empty input gives an
    empty result; other columns, whatever their names, stay in ``row``.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    doc, text = F.col("row")[id_col], F.coalesce(F.col("row")[text_col], F.lit(""))
    own = F.xxhash64(text)
    lines = rows.where(doc.isNotNull()).select(doc.alias("doc"), own.alias("own"), F.posexplode(split_lines(text)).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= min_chars).select("doc", "own", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    held = keys.select("doc", "own", "pos", hash128(F.col("key")).alias("h")).select("doc", "own", "pos", "h.a", "h.b")

    shared = written(
        held.groupBy("a", "b", "doc").agg(F.lit(1).alias("one"))
        .groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
        .where(F.col("docs") >= min_docs).select("a", "b", "keeper"), "shared-lines",
    )
    drops = held.join(shared, ["a", "b"]).where(F.col("doc") != F.col("keeper")).groupBy("doc", "own").agg(F.collect_set("pos").alias("drop"))

    all_lines = split_lines(text)
    last = F.size(all_lines) - 1
    kept = F.when(F.col("drop").isNull(), text).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), last), F.col("drop")), lambda i: F.get(all_lines, i)), "\n")
    )
    return rows.join(drops, (doc == F.col("doc")) & (own == F.col("own")), "left").select(
        "row", F.size(all_lines).cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias("n_dropped"), kept.alias("kept")
    )
