"""Queries of the record and pair audits, as rule tables, with the SQL that states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.operators import quality
from lodestar.operators.quality import Rule
from lodestar.plans.base import frame, sql
from lodestar.plans.scoring import _any


def record_rules() -> list[Rule]:
    """Presence, types of values, consistency and wording of a record."""
    c = F.col
    topological, label = c("relation") == "topological", F.lower(F.trim("subtype"))
    lo, hi = (F.coalesce(*[F.when(c("difficulty") == k, F.lit(v[i])) for k, v in V.LEVEL_RANGES.items()]) for i in (0, 1))
    return [
        Rule("relation_present", c("relation").isNotNull(), level=1, least_rate=0.99),
        Rule("relation_known", c("relation").isin(V.RELATIONS), level=1, applies=c("relation").isNotNull()),
        Rule("subtype_present", c("subtype").isNotNull(), level=1, applies=topological, least_rate=0.99),
        Rule("subtype_known", label.isin(V.TOPOLOGY), "warning", 1, applies=topological & c("subtype").isNotNull(), detail=label),
        Rule("two_entities", c("name2").isNotNull(), level=2, least_rate=0.9),
        Rule("first_in_box", geo.in_box(c("lon1"), c("lat1")), level=2, least_rate=0.98),
        Rule("score_in_range", c("score").between(lo, hi), "warning", 2, detail=c("difficulty")),
        Rule("yes_no_answer", T.contains_any(c("answer"), ["是", "否", "相邻", "不"]), "warning", 2, applies=c("question").contains("是否")),
        Rule("question_length", F.char_length("question").between(10, 200), "warning", 4),
        Rule("names_in_question", c("question").contains(c("name1")), "warning", 4),
        Rule("no_leading_phrase", ~c("question").rlike("^请"), "info", 4),
        Rule("no_coordinates", ~T.has_coordinates(c("question")), "info", 4),
        Rule("topology_words", T.contains_any(c("answer"), V.TOPOLOGY_DEFAULT), "warning", 4, applies=topological, least_rate=0.8),
    ]


_RULE_SQL = [
    # name, ok, applies, least rate
    ("relation_present", "relation IS NOT NULL", "true", 0.99),
    ("relation_known", "relation IN ('directional', 'topological', 'metric', 'composite')", "relation IS NOT NULL", 1.0),
    ("subtype_present", "subtype IS NOT NULL", "relation = 'topological'", 0.99),
    ("subtype_known", "lower(trim(subtype)) IN ('within', 'contains', 'adjacent', 'disjoint', 'overlap')", "relation = 'topological' AND subtype IS NOT NULL", 1.0),
    ("two_entities", "name2 IS NOT NULL", "true", 0.9),
    ("first_in_box", "lon1 BETWEEN 73 AND 135 AND lat1 BETWEEN 18 AND 54", "true", 0.98),
    ("score_in_range", "CASE difficulty WHEN 'easy' THEN score BETWEEN 1.0 AND 2.0 WHEN 'medium' THEN score BETWEEN 2.0 AND 3.5 ELSE score BETWEEN 3.5 AND 5.0 END", "true", 1.0),
    ("yes_no_answer", _any("answer", ["是", "否", "相邻", "不"]), "contains(question, '是否')", 1.0),
    ("question_length", "length(question) BETWEEN 10 AND 200", "true", 1.0),
    ("names_in_question", "contains(question, name1)", "true", 1.0),
    ("no_leading_phrase", "NOT starts_with(question, '请')", "true", 1.0),
    ("no_coordinates", f"NOT regexp_matches(question, '{'|'.join('(?:' + p + ')' for p in V.COORDINATE_PATTERNS)}')", "true", 1.0),
    ("topology_words", _any("answer", V.TOPOLOGY_DEFAULT), "relation = 'topological'", 0.8),
]


def pair_rules() -> list[Rule]:
    c = F.col
    symmetric = c("relation").isin("geo.metric", "geo.touches", "geo.disjoint")
    return [
        Rule("different_entities", c("a") != c("b")),
        Rule("id_format", c("pair_id").rlike(r"^[a-z]+_x_\d+$")),
        Rule("prefix_of_direction", c("pair_id").startswith("dir"), "warning", applies=c("relation").contains("direction")),
        Rule("distance_positive", c("km") > 0, applies=c("relation").contains("metric")),
        Rule("azimuth_in_circle", c("azimuth").between(0, 359)),
        Rule("both_in_box", geo.in_box(c("a_lon"), c("a_lat")) & geo.in_box(c("b_lon"), c("b_lat"))),
        Rule("same_types_rare", c("a_type") != c("b_type"), "info", applies=symmetric, least_rate=0.5),
    ]


_PAIR_SQL = [
    ("different_entities", "a <> b", "true", 1.0),
    ("id_format", "regexp_matches(pair_id, '^[a-z]+_x_[0-9]+$')", "true", 1.0),
    ("prefix_of_direction", "starts_with(pair_id, 'dir')", "contains(relation, 'direction')", 1.0),
    ("distance_positive", "km > 0", "contains(relation, 'metric')", 1.0),
    ("azimuth_in_circle", "azimuth BETWEEN 0 AND 359", "true", 1.0),
    ("both_in_box", "a_lon BETWEEN 73 AND 135 AND a_lat BETWEEN 18 AND 54 AND b_lon BETWEEN 73 AND 135 AND b_lat BETWEEN 18 AND 54", "true", 1.0),
    ("same_types_rare", "a_type <> b_type", "relation IN ('geo.metric', 'geo.touches', 'geo.disjoint')", 0.5),
]


def _rates_sql(rules, table: str) -> str:
    one = [f"SELECT '{n}' AS check_name, count(*) FILTER (WHERE {a}) AS total, count(*) FILTER (WHERE ({a}) AND NOT coalesce({ok}, false)) AS failed, {least} AS least FROM {table}" for n, ok, a, least in rules]
    return sql(f"WITH u AS ({' UNION ALL '.join(one)}) SELECT check_name, total, failed, round(coalesce(1 - failed / nullif(total, 0), 1), 6) AS pass_rate, coalesce(1 - failed / nullif(total, 0), 1) >= least AS passed FROM u", table)


def dq_record_rates(spark, sf_dir):
    return quality.pass_rates(frame(spark, sf_dir, "records"), record_rules()).withColumn("pass_rate", F.round("pass_rate", 6))


def dq_record_issues(spark, sf_dir):
    """All issues of records, with their check."""
    return quality.issues(frame(spark, sf_dir, "records"), record_rules()).select("record_id", "check_name")


def dq_valid_records(spark, sf_dir):
    """Valid and invalid rows under the rules of level 1."""
    ok, bad = quality.partition_valid(frame(spark, sf_dir, "records"), [r for r in record_rules() if r.level == 1])
    return ok.agg(F.lit("valid").alias("part"), F.count("*").alias("n"), F.sum("id").alias("ids")).unionByName(bad.agg(F.lit("invalid").alias("part"), F.count("*").alias("n"), F.sum("id").alias("ids")))


def dq_pair_rates(spark, sf_dir):
    return quality.pass_rates(frame(spark, sf_dir, "pairs"), pair_rules()).withColumn("pass_rate", F.round("pass_rate", 6))


def dq_duplicates(spark, sf_dir):
    """Repeated pair ids by how often they occur, and pairs that occur under one relation more than once."""
    p = frame(spark, sf_dir, "pairs")
    ids = quality.duplicates(p, ["pair_id"]).groupBy("n").agg(F.count("*").alias("keys")).select(F.lit("id").alias("what"), "n", "keys")
    key = quality.direction_free_key(F.col("relation"), F.col("a").cast("string"), F.col("b").cast("string"), ["geo.intersects", "geo.touches", "geo.direction"])
    both = quality.duplicates(p, ["relation", key.alias("key")]).groupBy("n").agg(F.count("*").alias("keys")).select(F.lit("pair").alias("what"), "n", "keys")
    return ids.unionByName(both)


def dq_attribute_conflicts(spark, sf_dir):
    """Entity names with more than one type, parent or position."""
    return quality.attribute_conflicts(frame(spark, sf_dir, "entities"), "name", ["type", "parent", "lon"])


def dq_id_gaps(spark, sf_dir):
    o = frame(spark, sf_dir, "orders").where("o_custkey % 3 > 0").selectExpr("o_orderpriority as prefix", "o_custkey % 2000 as number")
    return quality.id_gaps(o, "prefix", "number")


def dq_turn_gaps(spark, sf_dir):
    """Conversations whose turns are not consecutive, start late, or repeat a role."""
    t = frame(spark, sf_dir, "conversations")
    g = t.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_distinct("role").alias("roles"))
    return g.select("conv_id", "n", "roles", ((F.col("last") - F.col("first") + 1) != F.col("n")).alias("gap"))


def dq_prompt_share(spark, sf_dir):
    """Largest share of a prompt, question template shares, and topological balance."""
    r = frame(spark, sf_dir, "records").withColumn("template", F.regexp_replace("question", r"\d+(\.\d+)?", "#"))
    out = None
    for what in ("prompt_id", "template", "subtype"):
        c = r.where(F.col(what).isNotNull()).groupBy(what).agg(F.count("*").alias("n"))
        row = c.agg(F.lit(what).alias("what"), F.round(F.max("n") / F.sum("n"), 6).alias("largest"), F.count("*").alias("kinds"))
        out = row if out is None else out.unionByName(row)
    return out


def dq_question_types(spark, sf_dir):
    """Kinds of question by ordered patterns and relation, with questions under 10 or over 150 characters."""
    q, kind = F.col("question"), F.lit("其他")
    for name, patterns in reversed(V.QUESTION_KINDS.items()):
        kind = F.when(q.rlike("|".join(patterns)), name).otherwise(kind)
    rows = frame(spark, sf_dir, "records").select(kind.alias("kind"), F.coalesce("relation", F.lit("unknown")).alias("relation"), F.char_length(q).alias("n"))
    return rows.groupBy("kind", "relation").agg(F.count("*").alias("n"), F.count_if(F.col("n") < 10).alias("short"), F.count_if(F.col("n") > 150).alias("long"))


def dq_field_sets(spark, sf_dir):
    """How many records have all fields of each named set."""
    sets = {"base": ["question", "answer"], "typed": ["question", "answer", "relation"], "topology": ["relation", "subtype"], "pair": ["name1", "name2", "relation"]}
    r = frame(spark, sf_dir, "records")
    full = [F.count_if(sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int")) == len(cols)).alias(k) for k, cols in sets.items()]
    return r.agg(F.count("*").alias("total"), *full).unpivot("total", list(sets), "fields", "complete")


QUERIES = {
    f.__name__: f
    for f in (dq_record_rates, dq_record_issues, dq_valid_records, dq_pair_rates, dq_duplicates, dq_attribute_conflicts, dq_id_gaps, dq_turn_gaps, dq_prompt_share, dq_question_types, dq_field_sets)
}
_BAD1 = " OR ".join(f"(coalesce({a}, false) AND NOT coalesce({ok}, false))" for n, ok, a, _ in _RULE_SQL[:4])
_KEY = "CASE WHEN relation IN ('geo.intersects', 'geo.touches', 'geo.direction') THEN concat(least(a::VARCHAR, b::VARCHAR), '|', greatest(a::VARCHAR, b::VARCHAR)) ELSE concat(a, '|', b) END"
ORACLES = {
    "dq_record_rates": _rates_sql(_RULE_SQL, "records"),
    "dq_record_issues": sql(" UNION ALL ".join(f"SELECT id AS record_id, '{n}' AS check_name FROM records WHERE ({a}) AND NOT coalesce({ok}, false)" for n, ok, a, _ in _RULE_SQL), "records"),
    "dq_valid_records": sql(f"SELECT CASE WHEN {_BAD1} THEN 'invalid' ELSE 'valid' END AS part, count(*) AS n, sum(id)::BIGINT AS ids FROM records GROUP BY 1", "records"),
    "dq_pair_rates": _rates_sql(_PAIR_SQL, "pairs"),
    "dq_duplicates": sql(f"SELECT 'id' AS what, n, count(*) AS keys FROM (SELECT count(*) AS n FROM pairs GROUP BY pair_id) WHERE n > 1 GROUP BY n UNION ALL SELECT 'pair', n, count(*) FROM (SELECT count(*) AS n FROM pairs GROUP BY relation, {_KEY}) WHERE n > 1 GROUP BY n", "pairs"),
    "dq_attribute_conflicts": sql("SELECT * FROM (SELECT name, 'type' AS attribute, count(DISTINCT type) AS n_values FROM entities GROUP BY 1 UNION ALL SELECT name, 'parent', count(DISTINCT parent) FROM entities GROUP BY 1 UNION ALL SELECT name, 'lon', count(DISTINCT lon) FROM entities GROUP BY 1) WHERE n_values > 1", "entities"),
    "dq_id_gaps": "WITH d AS (SELECT DISTINCT o_orderpriority AS prefix, o_custkey % 2000 AS number FROM orders WHERE o_custkey % 3 > 0), l AS (SELECT *, lead(number) OVER (PARTITION BY prefix ORDER BY number) AS before FROM d) SELECT prefix, number AS after, before, before - number - 1 AS missing FROM l WHERE before - number > 1",
    "dq_turn_gaps": "SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles, max(turn) - min(turn) + 1 <> count(*) AS gap FROM conversations GROUP BY 1",
    "dq_prompt_share": sql(" UNION ALL ".join(f"SELECT '{w}' AS what, round(max(n) / sum(n), 6) AS largest, count(*) AS kinds FROM (SELECT count(*) AS n FROM (SELECT *, regexp_replace(question, '\\d+(\\.\\d+)?', '#', 'g') AS template FROM records) WHERE {w} IS NOT NULL GROUP BY {w})" for w in ("prompt_id", "template", "subtype")), "records"),
    "dq_question_types": sql("""SELECT CASE WHEN regexp_matches(question, '是否|是不是|有没有|吗[？?]$') THEN '是非问句' WHEN regexp_matches(question, '什么|哪里|哪个|多少|多远|如何') THEN '特指问句' WHEN regexp_matches(question, '还是|或者') THEN '选择问句'
        WHEN regexp_matches(question, '描述|说明|解释|分析') THEN '描述问句' ELSE '其他' END AS kind, coalesce(relation, 'unknown') AS relation, count(*) AS n, count(*) FILTER (WHERE length(question) < 10) AS short, count(*) FILTER (WHERE length(question) > 150) AS long FROM records GROUP BY ALL""", "records"),
    "dq_field_sets": sql("WITH s AS (SELECT count(*) AS total, count(*) FILTER (WHERE question IS NOT NULL AND answer IS NOT NULL) AS base, count(*) FILTER (WHERE question IS NOT NULL AND answer IS NOT NULL AND relation IS NOT NULL) AS typed, count(*) FILTER (WHERE relation IS NOT NULL AND subtype IS NOT NULL) AS topology, count(*) FILTER (WHERE name1 IS NOT NULL AND name2 IS NOT NULL AND relation IS NOT NULL) AS pair FROM records) SELECT total, fields, complete FROM s UNPIVOT (complete FOR fields IN (base, typed, topology, pair))", "records"),
}
