"""Registered queries over the text tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import alignment, cost_packing, embedding_dedup, fim, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_model, quality_rules, toxicity, warc
from lodestar.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, reads them back in ranges, and takes sizes and digests from the payloads read."""
    records = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")), split_bytes=4 << 20)
    whole = F.col("payload").isNotNull()
    return records.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, warc.sha1_base32(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's slot in the mix; blocks of 256 Ki code points."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))
    placed = mixing.mix_sources(docs, size=F.col("chars"), block=1 << 18)
    return placed.select("row.doc_id", "row.source", F.col("row.chars").cast("long").alias("chars"), "source_block", "slot", "place")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).drop("one", "two")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each new text and of the text rebuilt from it."""
    out, output = fim.fill_in_middle(table(spark, sf_dir, "documents")), F.col("output")
    digests = [F.sha2(output, 256).alias("output_sha256"), F.sha2(fim.restored(output, F.col("form")), 256).alias("restored_sha256")]
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest takes the place of the groups before they are stored."""
    return alignment.align(table(spark, sf_dir, "documents"), derive=lambda c: F.sha2(c, 256)).withColumnRenamed("groups", "groups_sha256")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {_ASCII_LOWER.format(f"trim(line, {_WS})")} AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP7_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, source IS NULL AS no_host, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, w, row_number() OVER (PARTITION BY rid ORDER BY i) AS pos FROM (
    SELECT rid, unnest(parts) AS w, generate_subscripts(parts, 1) AS i
    FROM (SELECT rid, string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+') AS parts FROM docs)) WHERE w <> ''),
wins AS (
  SELECT rid, pos, list(w) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM words),
rep AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS c FROM wins WHERE len(win) = 8),
cov AS (
  SELECT rid, sum(least(8, coalesce(nxt - pos, 8))) AS n FROM (
    SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS nxt FROM rep WHERE c >= 2) GROUP BY rid),
wagg AS (
  SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars,
         sum(length(w) - length(regexp_replace(w, '[#*$%&|<>]', '', 'g'))) AS n_symbols FROM words GROUP BY rid),
lines AS (
  SELECT rid, doc_id, host, no_host, text, unnest(string_split(text, chr(10))) AS line FROM docs),
full_lines AS (
  SELECT *, {_ASCII_LOWER.format(f"trim(line, {_WS})")} AS key,
         len(string_split_regex(trim(line, {_WS}), '[ \\t\\n\\x0B\\f\\r]+')) AS n FROM lines WHERE trim(line, {_WS}) <> ''),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY rid),
freq AS (
  SELECT no_host, host, key FROM full_lines GROUP BY ALL
  HAVING count(DISTINCT CASE WHEN doc_id IS NULL THEN 't' || text ELSE 'd' || doc_id END) > 10),
gone AS (
  SELECT f.rid, sum(f.n) AS n FROM full_lines f JOIN freq USING (no_host, host, key) GROUP BY f.rid),
figs AS (
  SELECT d.doc_id, coalesce(w.n_words, 0)::BIGINT AS n_words, coalesce(w.word_chars, 0)::BIGINT AS word_chars,
         coalesce(w.n_symbols, 0)::BIGINT AS n_symbols, coalesce(u.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_boilerplate_words
  FROM docs d LEFT JOIN wagg w USING (rid) LEFT JOIN dup u USING (rid) LEFT JOIN cov c USING (rid) LEFT JOIN gone g USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_boilerplate_words) >= 30 * n_words AS kept
FROM figs
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
d AS (SELECT *, sha1(html) AS hex FROM p),
e AS (SELECT page_id, html, keeper, string_agg(lpad(to_base(('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT, 32), 4, '0'), '' ORDER BY i) AS b
      FROM d, (SELECT unnest(range(8)) AS i) GROUP BY page_id, html, keeper)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       translate(b, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM e
"""

OP11_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units FROM documents),
k AS (
  SELECT *, len(units) AS n, ('0x' || substr(hex, 1, 8))::BIGINT % (len(units) + 1) AS one,
         ('0x' || substr(hex, 9, 8))::BIGINT % (len(units) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(hex, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(hex, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(list_slice(units, 1, least(one, two)), ''), '') AS pre,
         coalesce(array_to_string(list_slice(units, least(one, two) + 1, greatest(one, two)), ''), '') AS mid,
         coalesce(array_to_string(list_slice(units, greatest(one, two) + 1, n), ''), '') AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_quality_model": op3_quality_model,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_cost_packing": op12_cost_packing,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op6_warc": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
