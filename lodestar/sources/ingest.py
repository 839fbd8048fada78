"""Record files read line by line: numbered lines, bad lines and wrong types as issues, figures by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values: fields of a record and the types of value that they may have
REQUIRED = {
    "id": ["string"], "spatial_relation_type": ["string"], "question": ["string"], "answer": ["string"], "reasoning_chain": ["array"], "entities": ["array"],
    "spatial_tokens": ["array"], "entity_to_token": ["object"], "difficulty": ["string"], "difficulty_score": ["number"],
}


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text) of every line of text files; lines count from 1 in each file, blank ones too.

    Spark reads a file in blocks, and a block's lines in order. Numbers that grow within a task give a line's place in its block, and the blocks'
    sizes, a row each, are added up along the file; the lines themselves are not shuffled.
    """
    read = lambda: spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text")
    )
    blocks = read().groupBy("file", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(W.partitionBy("file").orderBy("block")) - F.col("lines")
    starts = blocks.select(F.col("file").alias("of"), F.col("block").alias("at"), "first", before.alias("before"))
    lines = read().join(starts, (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")))
    return lines.select("file", (F.col("before") + F.col("n") - F.col("first") + 1).alias("line"), "text")


def typed(value: Column, field: str) -> Column:
    """missing, null, or the JSON type of a field of a VARIANT object: string, number, boolean, array or object."""
    got = F.try_variant_get(value, f"$.{field}", "variant")
    name = F.regexp_extract(F.schema_of_variant(got), "^([A-Z]+)", 1)
    kind = F.when(name.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "number").otherwise(F.lower(name))
    return F.when(got.isNull(), "missing").when(F.is_variant_null(got), "null").otherwise(kind)


def records(lines: DataFrame, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """The lines with ``status`` (blank, bad, or record) and ``types``: for each field missing, null or its JSON type. A line that is not a JSON object is bad."""
    value = F.try_parse_json("text")
    plain = F.schema_of_variant(value).startswith("OBJECT")
    status = F.when(F.trim("text") == "", "blank").when(value.isNotNull() & plain, "record").otherwise("bad")
    types = F.struct(*[typed(F.col("value"), f).alias(f) for f in fields or REQUIRED])
    rows = lines.select("*", status.alias("status"), value.alias("value"))
    return rows.withColumn("types", F.when(F.col("status") == "record", types)).drop("value")


def issues(rows: DataFrame, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """(file, line, check, field, actual): a row for each bad line (L1-4), and for each record the fields that are missing or null (L1-1) or of
    another type than they may have (L1-2). rows: as ``records`` gives them, with the same fields."""
    fields = fields or REQUIRED
    one = lambda when, check, field, actual: F.when(when, F.struct(F.lit(check).alias("check"), F.lit(field).alias("field"), actual.alias("actual")))
    found = [one(F.col("status") == "bad", "L1-4", "", F.left("text", F.lit(80)))]
    for f, allowed in fields.items():
        kind = F.col(f"types.{f}")
        found.append(one(kind.isin("missing", "null"), "L1-1", f, kind))
        found.append(one(~kind.isin("missing", "null", *allowed), "L1-2", f, kind))
    return rows.select("file", "line", F.explode(F.array_compact(F.array(*found))).alias("i")).select("file", "line", "i.*")


def by_file(rows: DataFrame, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each file in one aggregate: records, blank and bad lines, and for each field how many records have it (has_...) and how many of
    those with a value of a type that it may not have (wrong_...)."""
    figures = [F.count_if(F.col("status") == s).alias(n) for s, n in (("record", "records"), ("blank", "blank"), ("bad", "bad"))]
    for f, allowed in (fields or REQUIRED).items():
        kind = F.col(f"types.{f}")
        figures += [F.count_if(kind != "missing").alias(f"has_{f}"), F.count_if(~kind.isin("missing", "null", *allowed)).alias(f"wrong_{f}")]
    return rows.groupBy("file").agg(*figures)


def json_arrays(df: DataFrame, path: str) -> None:
    """JSON files that are arrays of records, one for each task: read again by ``readers.json_documents``. The rows of a file pass one by
    one; brackets and commas are put around them as lines of text."""
    from lodestar.sources.scratch import stored

    n, part = F.monotonically_increasing_id(), F.spark_partition_id()
    rows = stored(df.select(part.alias("part"), n.alias("n"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")), "arrays")
    ends = rows.groupBy("part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    line = F.concat(F.when(F.col("n") == F.col("low"), "[\n").otherwise(""), "json", F.when(F.col("n") == F.col("high"), "\n]").otherwise(","))
    texts = rows.join(ends, "part").repartition("part").sortWithinPartitions("part", "n").select("part", line.alias("value"))
    texts.write.partitionBy("part").text(path)
