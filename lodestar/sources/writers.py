"""Writers of record files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, characters as they are; one file per task."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def by_split(df: DataFrame, path: str) -> None:
    """One folder per value of `split`, which the records keep, too."""
    df.withColumn("split of folder", F.col("split")).write.partitionBy("split of folder").json(path, ignoreNullFields=False)


def append_new(df: DataFrame, path: str, id_col: str) -> None:
    """Appends the rows whose id is not yet there, so that a repeated run adds nothing. (StoredTable.append also names each change.)"""
    from pyspark.errors import AnalysisException

    try:
        done = df.sparkSession.read.parquet(path).select(id_col)
    except AnalysisException:
        done = df.select(id_col).limit(0)
    df.join(done, id_col, "left_anti").write.mode("append").parquet(path)


def csv_report(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def texts(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.text(path)


def markdown(df: DataFrame, most_rows: int = 1000) -> str:
    """A table of an aggregate of at most so many rows; more are an error, never cut off."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows; aggregate them first")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])
