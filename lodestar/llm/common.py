"""Helpers shared by the training-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.sources.scratch import scratch, shared_dir
from lodestar.sources.scratch import stored as written

__all__ = ["scratch", "shared_dir", "written"]

#: ASCII white space, as the contents of a regular-expression class and as plain characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(col: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; nulls give null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def slices(batches, rows: int = 512):
    """pandas frames of a few rows at a time from Arrow batches, so that long texts are not held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pandas(integer_object_nulls=True)


def map_slices(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInPandas over small frames (see slices); fn takes and gives an iterator of frames."""

    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        import pyarrow as pa

        for frame in fn(slices(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=kind, preserve_index=False)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn(frame) -> frame for the rows of each key, like applyInPandas, but many small groups share an
    Arrow batch; a task holds one batch and one group at a time."""

    def run(batches):
        import numpy as np
        import pandas as pd

        held = []

        def results(frame):
            codes = [frame[k].to_numpy() for k in keys]
            new = np.zeros(len(frame), bool)
            for c in codes:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(frame)]
            return [frame.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

        for frame in batches:
            if not len(frame):
                continue
            first, last = frame.iloc[0], held and held[-1].iloc[-1]
            if held and any(first[k] != last[k] for k in keys):
                yield fn(pd.concat(held, ignore_index=True))
                held = []
            groups = results(frame)
            held.append(groups[0])
            if len(groups) > 1:
                out = [fn(pd.concat(held, ignore_index=True)), *map(fn, groups[1:-1])]
                held = [groups[-1]]
                yield pd.concat(out, ignore_index=True)
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    lower() does the same wherever no other character has case; only the rest pays for translate().
    """
    other_case = col.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^\x00-\x7F]]")
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain | ~other_case, F.lower(col)).otherwise(F.translate(col, _UPPER, _UPPER.lower()))


def hash128(*cols: Column) -> Column:
    """Two independently seeded 64-bit hashes as a struct: wide enough to stand for the value."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(0x5EED), *cols).alias("b"))
