"""Readers of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed schema of a question/answer record; `_raw` keeps the line, since a struct cannot tell a missing key from null.
RECORD_SCHEMA = (
    "id string, spatial_relation_type string, topology_subtype string, question string, answer string, difficulty string, difficulty_score double, "
    "prompt_id string, split string, entities array<struct<name: string, type: string, coords: array<double>>>, spatial_tokens array<string>, "
    "entity_to_token map<string, struct<char_start: int, char_end: int, token_indices: array<int>>>, "
    "reasoning_chain array<struct<step: int, name: string, action: string, content: string, entities_involved: array<string>, relation_type: string, "
    "coordinates: map<string, array<double>>, calculation_result: string, final_answer: string>>"
)


def jsonl(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, on_bad: str = "fail") -> DataFrame:
    """JSON lines; blank lines are skipped. on_bad: "fail", "drop", or "keep", which adds `_raw`, `_bad` and `_file`."""
    if on_bad != "keep":
        return spark.read.schema(schema).json(path, mode={"fail": "FAILFAST", "drop": "DROPMALFORMED"}[on_bad])
    lines = spark.read.text(path).select(F.col("value").alias("_raw"), F.col("_metadata.file_name").alias("_file")).where(F.trim("_raw") != "")
    value = F.try_parse_json("_raw")
    return lines.select("_raw", "_file", value.isNull().alias("_bad"), F.from_json("_raw", schema).alias("r")).select("_raw", "_file", "_bad", "r.*")


def key_states(df: DataFrame, keys: list[str], raw: str = "_raw") -> DataFrame:
    """For each key whether the raw record has it: "missing", "null", or the JSON type of its value."""
    value = F.try_parse_json(raw)

    def state(key: str):
        got = F.try_variant_get(value, f"$.{key}", "variant")
        present = F.array_contains(F.json_object_keys(raw), key)
        return F.when(~F.coalesce(present, F.lit(False)), "missing").when(F.coalesce(F.is_variant_null(got), F.lit(True)), "null").otherwise(F.lower(F.regexp_extract(F.schema_of_variant(got), "^([A-Z]+)", 1)))

    return df.select("*", *[state(k).alias(f"state_{k}") for k in keys])


def json_documents(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Whole-file JSON: a list of records, an object with a list under "data", or one record."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    as_list = F.when(F.ltrim("v").startswith("["), F.from_json("v", f"array<struct<{schema}>>"))
    inner = F.from_json("v", f"data array<struct<{schema}>>")["data"]
    return whole.select(F.inline(F.coalesce(as_list, inner, F.array(F.from_json("v", schema)))))


def with_counts_by_file(df: DataFrame, file_col: str = "_file") -> DataFrame:
    return df.groupBy(file_col).agg(F.count("*").alias("records"))


def geo_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity lists: id, type, names, lon, lat, and the geometry as text, whichever of point, object or null it is."""
    fields = "entity_id string, type string, name_zh string, name_en string, geometry_type string, centroid array<double>, geometry string"
    rows = json_documents(spark, path, fields)
    return rows.select("entity_id", "type", "name_zh", "name_en", "geometry_type", F.get("centroid", F.lit(0)).alias("lon"), F.get("centroid", F.lit(1)).alias("lat"), "geometry")
