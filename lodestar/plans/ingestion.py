"""Queries that write record files from a table and read them back line by line."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.plans.base import frame, sql
from lodestar.sources import ingest
from lodestar.sources.scratch import scratch

FIELDS = {"id": ["string"], "question": ["string"], "score": ["number"], "tokens": ["array"]}
#: A record as a line of text: keys that are missing, null or of another type, broken and blank lines. SQL of both engines.
_FILE = "CAST(floor(id / 500) AS BIGINT)"
_LINE = """CASE WHEN id % 17 = 0 THEN concat('{"id":"r', id, '","question"') WHEN id % 19 = 0 THEN '' ELSE concat('{"id":', CASE WHEN id % 23 = 0 THEN '7' ELSE concat('"r', id, '"') END,
    CASE WHEN id % 7 = 0 THEN '' WHEN id % 11 = 0 THEN ',"question":null' ELSE concat(',"question":"', question, '"') END, ',"score":', CASE WHEN id % 13 = 0 THEN '"high"' ELSE CAST(length AS VARCHAR(20)) END, CASE WHEN id % 5 = 0 THEN ',"tokens":{}' ELSE ',"tokens":["a"]' END, '}') END"""


def _rows(spark, sf_dir):
    """The records, written as files of five hundred lines in the order of their ids, and read as numbered lines."""
    path = scratch(spark, "lines")
    lines = frame(spark, sf_dir, "records").selectExpr("id", f"{_FILE} AS f", f"{_LINE} AS value")
    lines.repartition("f").sortWithinPartitions("f", "id").select("f", "value").write.partitionBy("f").text(path)
    numbered = ingest.numbered_lines(spark, path).withColumn("file", F.regexp_extract("file", r"/f=(\d+)/", 1).cast("long"))
    return ingest.records(numbered, FIELDS)


def src_issues(spark, sf_dir):
    """Bad lines, and fields that are missing, null or of a wrong type, with file and line."""
    return ingest.issues(_rows(spark, sf_dir), FIELDS)


def src_files(spark, sf_dir):
    """Records, blank and bad lines of each file, and how many records have each field, and with a wrong type."""
    return ingest.by_file(_rows(spark, sf_dir), FIELDS)


QUERIES = {f.__name__: f for f in (src_issues, src_files)}
_CTE = f"""WITH n AS (SELECT {_FILE} AS file, row_number() OVER (PARTITION BY {_FILE} ORDER BY id) AS line, id, {_LINE} AS text, id % 17 = 0 AS bad, id % 19 = 0 AND id % 17 > 0 AS blank, id % 17 > 0 AND id % 19 > 0 AS good FROM records)"""
ORACLES = {
    "src_issues": sql(_CTE + """ SELECT file, line, 'L1-4' AS "check", '' AS field, left(text, 80) AS actual FROM n WHERE bad
        UNION ALL SELECT file, line, 'L1-1', 'question', CASE WHEN id % 7 = 0 THEN 'missing' ELSE 'null' END FROM n WHERE good AND (id % 7 = 0 OR id % 11 = 0)
        UNION ALL SELECT file, line, 'L1-2', 'id', 'number' FROM n WHERE good AND id % 23 = 0 UNION ALL SELECT file, line, 'L1-2', 'score', 'string' FROM n WHERE good AND id % 13 = 0
        UNION ALL SELECT file, line, 'L1-2', 'tokens', 'object' FROM n WHERE good AND id % 5 = 0""", "records"),
    "src_files": sql(_CTE + """ SELECT file, count(*) FILTER (WHERE good) AS records, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE bad) AS bad,
        count(*) FILTER (WHERE good) AS has_id, count(*) FILTER (WHERE good AND id % 23 = 0) AS wrong_id, count(*) FILTER (WHERE good AND id % 7 > 0) AS has_question, 0 AS wrong_question, count(*) FILTER (WHERE good) AS has_score,
        count(*) FILTER (WHERE good AND id % 13 = 0) AS wrong_score, count(*) FILTER (WHERE good) AS has_tokens, count(*) FILTER (WHERE good AND id % 5 = 0) AS wrong_tokens FROM n GROUP BY file""", "records"),
}
