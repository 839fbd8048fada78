"""Queries that screen whole records, made as lines of JSON with known faults, and accept finished datasets; the SQL states the faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import score
from lodestar.operators import sampling, screen
from lodestar.plans.base import frame, pick, sql
from lodestar.plans.scoring import _v2

_KIND = "CASE WHEN id % 29 = 0 THEN 'strange' ELSE " + pick("id", ["directional", "topological", "metric", "composite"]) + " END"


def _json() -> str:
    """A record as JSON text, by conditions on its id; SQL of both engines."""
    when = lambda m, yes, no: f"CASE WHEN id % {m} = 0 THEN {yes} ELSE {no} END"
    city, river = "concat('城市', id)", "concat('河流', id)"
    quoted = lambda e: f"""concat('"', {e}, '"')"""
    place = "CASE WHEN id % 59 = 0 THEN ',\"coords\":[10,10]' WHEN id % 61 = 0 THEN ',\"coords\":[1]' WHEN id % 67 = 0 THEN '' ELSE ',\"coords\":[110.5,30.5]' END"
    one = f"""concat('{{"name":"', {city}, '","type":"', {when(53, "'galaxy'", "'city'")}, '"', {place}, '}}')"""
    two = f"""concat('{{', {when(101, "''", f"concat('\"name\":\"', {river}, '\",')")}, '"type":"river","coords":[100.5,30.5]}}')"""
    entities = f"""concat('[', {one}, {when(47, "''", f"concat(',', {two})")}, ']')"""
    tokens = f"""CASE WHEN id % 73 = 0 THEN '[]' WHEN id % 79 = 0 THEN concat('[', {quoted(city)}, ',', {quoted(river)}, ',"关系","外星"]') WHEN id % 83 = 0 THEN concat('[', {quoted(city)}, ',"关系"]') ELSE concat('[', {quoted(city)}, ',', {quoted(river)}, ',"之间","关系"]') END"""
    steps = [
        f"""concat('{{"step":1,"name":"entity_identification","action":"extract_entities","content":"x","entities_involved":[', {quoted(city)}, ',', {quoted(river)}, {when(103, "',\"幽灵\"'", "''")}, ']}}')""",
        f"""concat('{{"step":2,"name":"spatial_relation_extraction"', {when(89, "''", "',\"action\":\"classify_relation\"'")}, {when(113, "',\"relation_type\":\"x\"'", "''")}, ',"content":"x"}}')""",
        """concat('{"step":3,"name":"', CASE WHEN id % 97 = 0 THEN 'magic' WHEN id % 109 = 0 THEN 'entity_identification' ELSE 'coordinate_retrieval' END, '","action":"infer_entity_to_token","content":"x"}')""",
        f"""concat('{{"step":', {when(107, "'40'", "'4'")}, ',"name":"spatial_calculation","action":"calculate","content":"x"', {when(127, "',\"calculation_result\":1'", "''")}, '}}')""",
        f"""concat('{{"step":5,"name":"answer_generation","action":"generate_answer","content":"x","final_answer":"', {when(11, "'两地不相邻'", "'两地相邻'")}, '"}}')""",
    ]
    chain = f"concat('[', {steps[0]}, ',', {steps[1]}, ',', {steps[2]}, ',', {steps[3]}, {when(71, "''", f"concat(',', {steps[4]})")}, ']')"
    mapped = f"""concat('{{', {quoted(city)}, ':{{"char_start":0,"char_end":2', {when(137, "''", "',\"token_indices\":[1]'")}, '}}', {when(131, "''", f"concat(',', {quoted(river)}, ':{{\"char_start\":4,\"char_end\":6,\"token_indices\":[2]}}')")}, '}}')"""
    subtype = f"""CASE WHEN id % 4 = 1 AND id % 29 > 0 AND id % 31 > 0 THEN concat(',"topology_subtype":"', {when(37, "'touchy'", "'within'")}, '"') ELSE '' END"""
    question = when(23, "'短'", f"concat({city}, '与', {river}, '之间是什么关系呢')")
    return f"""concat('{{"id":"r', id, '","spatial_relation_type":"', {_KIND}, '"', {subtype}, ',"question":"', {question}, '","answer":"', {when(19, "'是'", "'两地相邻'")}, '","difficulty":"', {when(41, "'extreme'", "'easy'")},
        '","difficulty_score":', {when(43, "'9.5'", "'1.5'")}, ',"reasoning_chain":', {chain}, ',"entities":', {entities}, ',"spatial_tokens":', {tokens}, {when(17, "''", f"concat(',\"entity_to_token\":', {mapped})")}, ',"_fixed":true}}')"""


def _lines(spark, sf_dir):
    return frame(spark, sf_dir, "documents").selectExpr("doc_id AS id").selectExpr("id", f"{_json()} AS text")


def dq_screen(spark, sf_dir):
    """Every finding of every rule about whole records."""
    return screen.anomalies(_lines(spark, sf_dir))


def dq_screen_rates(spark, sf_dir):
    """Findings, records and pass rates of every rule by relation."""
    lines = _lines(spark, sf_dir)
    return screen.rates(lines, screen.anomalies(lines)).withColumn("rate", F.round("rate", 6))


def prj_without_internal(spark, sf_dir):
    """Records without their internal fields: how many fields are left, and whether any internal one is."""
    kept = screen.without_fields(_lines(spark, sf_dir))
    keys = F.json_object_keys("text")
    return kept.groupBy(F.size(keys).alias("fields")).agg(F.count("*").alias("n"), F.count_if(F.array_contains(keys, "_fixed")).alias("internal"))


def dq_accepted(spark, sf_dir):
    """A split of the answers against exact sizes, shares of types and levels, and pairs of texts that two splits share."""
    rows = sampling.ratio_split(frame(spark, sf_dir, "answers").select("id", "spatial_type", "difficulty", F.concat_ws("|", "prediction", "reference").alias("pair")), [])
    shares = {"spatial_type": {"directional": 0.25, "topological": 0.275, "metric": 0.275, "composite": 0.2}, "difficulty": {"easy": 0.3, "medium": 0.5, "hard": 0.2}}
    out = screen.accepted(rows, {"train": 800, "dev": 100, "test": 100}, shares, "pair")
    return out.withColumn("actual", F.round("actual", 6))


def ev_error_patterns(spark, sf_dir):
    """Counters of the ways in which predictions go wrong: inside where the reference does not say so, one distance again and again, wrong directions, bad form."""
    p, r, t = F.col("prediction"), F.col("reference"), F.col("spatial_type")
    patterns = {
        "topological_bias": (t == "topological") & F.contains(p, F.lit("内部")) & ~F.contains(r, F.lit("内部")), "distance_bias": F.contains(p, F.lit("1200公里")) & ~F.contains(r, F.lit("1200")),
        "direction_confusion": (t == "directional") & ~score.correct_v2(t, p, r), "format_issues": ~score.format_valid(p),
    }
    rows = frame(spark, sf_dir, "answers").select("difficulty", *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in patterns.items()])
    return rows.unpivot("difficulty", list(patterns), "pattern", "hit").groupBy("pattern", "difficulty").agg(F.sum("hit").alias("n"))


QUERIES = {f.__name__: f for f in (dq_screen, dq_screen_rates, prj_without_internal, dq_accepted, ev_error_patterns)}

_CITY, _RIVER, _FIVE, _MAP = "concat('城市', id)", "concat('河流', id)", "id % 71 > 0", "id % 17 > 0"
_NO_RIVER = "(id % 47 = 0 OR id % 101 = 0)"
#: check: (condition, detail)
_FAULTS = [
    ("missing_field", "id % 17 = 0", "'entity_to_token'"), ("unknown_relation", "id % 29 = 0", "'strange'"), ("missing_subtype", "id % 4 = 1 AND id % 29 > 0 AND id % 31 = 0", "''"),
    ("unknown_subtype", "id % 4 = 1 AND id % 29 > 0 AND id % 31 > 0 AND id % 37 = 0", "'touchy'"), ("unknown_difficulty", "id % 41 = 0", "'extreme'"), ("score_out_of_range", "id % 43 = 0", "'9.5'"),
    ("question_length", "id % 23 = 0", "'1'"), ("answer_length", "id % 19 = 0", "'1'"), ("chain_length", "id % 71 = 0", "'4'"), ("few_entities", "id % 47 = 0", "'1'"), ("no_tokens", "id % 73 = 0", "''"),
    ("token_count", "id % 73 > 0 AND id % 79 > 0 AND id % 83 = 0", "'2'"), ("answer_contradicts", f"id % 11 = 0 AND id % 19 > 0 AND {_FIVE}", "''"), ("step_field", "id % 89 = 0", "'2:action'"),
    ("step_number", f"id % 107 = 0 AND {_FIVE}", "'4'"), ("step_name", "id % 97 = 0", "'magic'"), ("step_order", f"id % 97 > 0 AND id % 109 = 0 AND {_FIVE}", "'3'"),
    ("entity_unknown", _NO_RIVER, _RIVER), ("entity_unknown", "id % 103 = 0", "'幽灵'"), ("leaked_relation_type", "id % 113 = 0", "'2'"), ("leaked_calculation_result", "id % 127 = 0", "CASE WHEN id % 107 = 0 THEN '40' ELSE '4' END"),
    ("entity_without_name", "id % 101 = 0 AND id % 47 > 0", "''"), ("entity_kind", "id % 53 = 0", "'galaxy'"), ("entity_without_place", "id % 59 > 0 AND id % 61 > 0 AND id % 67 = 0", _CITY), ("place_format", "id % 59 > 0 AND id % 61 = 0", _CITY),
    ("place_outside", "id % 59 = 0", _CITY), ("name_unmapped", f"id % 131 = 0 AND {_MAP} AND NOT {_NO_RIVER}", _RIVER), ("mapping_keys", f"id % 137 = 0 AND {_MAP}", _CITY),
    ("token_not_in_question", "id % 73 > 0 AND id % 79 = 0", "'外星'"), ("token_not_in_question", "id % 23 = 0 AND id % 73 > 0", _CITY), ("token_not_in_question", "id % 23 = 0 AND id % 73 > 0", "'关系'"),
    ("token_not_in_question", "id % 23 = 0 AND id % 73 > 0 AND (id % 79 = 0 OR id % 83 > 0)", _RIVER), ("token_not_in_question", "id % 23 = 0 AND id % 73 > 0 AND id % 79 > 0 AND id % 83 > 0", "'之间'"),
]
_FOUND = f"d AS (SELECT doc_id AS id FROM documents), k AS (SELECT id, {_KIND} AS relation FROM d), f AS (" + " UNION ALL ".join(f"SELECT concat('r', id) AS record_id, relation, '{c}' AS \"check\", {x} AS detail FROM k WHERE {w}" for c, w, x in _FAULTS) + ")"
_SPLIT = """r AS (SELECT id, spatial_type, difficulty, concat(prediction, '|', reference) AS pair, row_number() OVER (ORDER BY md5(concat(id, '|42')), id) AS r, count(*) OVER () AS n FROM answers),
        s AS (SELECT *, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM r)"""
ORACLES = {
    "dq_screen": f"WITH {_FOUND} SELECT * FROM f",
    "dq_screen_rates": f"""WITH {_FOUND}, t AS (SELECT relation, count(*) AS n FROM k GROUP BY 1) SELECT relation, "check", count(*) AS findings, count(DISTINCT record_id) AS records, round(1 - count(DISTINCT record_id) / max(n), 6) AS rate FROM f JOIN t USING (relation) GROUP BY ALL""",
    "prj_without_internal": "SELECT (10 + (doc_id % 4 = 1 AND doc_id % 29 > 0 AND doc_id % 31 > 0)::INT - (doc_id % 17 = 0)::INT)::INT AS fields, count(*) AS n, 0 AS internal FROM documents GROUP BY 1",
    "dq_accepted": sql(f"""WITH {_SPLIT}, c AS (SELECT split AS scope, count(*)::DOUBLE AS actual FROM s GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM s), g AS (SELECT * FROM (VALUES ('train', 800), ('dev', 100), ('test', 100), ('total', 1000)) v(scope, target)),
        w AS (SELECT * FROM (VALUES ('share of spatial_type', 'directional', 0.25), ('share of spatial_type', 'topological', 0.275), ('share of spatial_type', 'metric', 0.275), ('share of spatial_type', 'composite', 0.2), ('share of difficulty', 'easy', 0.3), ('share of difficulty', 'medium', 0.5), ('share of difficulty', 'hard', 0.2)) v(c, scope, target)),
        h AS (SELECT 'share of spatial_type' AS c, spatial_type AS scope, count(*) / (SELECT count(*) FROM s) AS actual FROM s GROUP BY 2 UNION ALL SELECT 'share of difficulty', difficulty, count(*) / (SELECT count(*) FROM s) FROM s GROUP BY 2),
        q AS (SELECT DISTINCT pair, split FROM s WHERE pair IS NOT NULL), z AS (SELECT concat(a.split, ' & ', b.split) AS scope, count(*) AS n FROM q a JOIN q b ON a.pair = b.pair AND a.split < b.split GROUP BY 1)
        SELECT 'count' AS "check", scope, target::DOUBLE AS target, coalesce(actual, 0) AS actual, coalesce(actual, 0) = target AS ok FROM g LEFT JOIN c USING (scope)
        UNION ALL SELECT w.c, scope, target::DOUBLE, round(coalesce(actual, 0), 6), abs(coalesce(actual, 0) - target) <= 0.05 FROM w LEFT JOIN h USING (c, scope)
        UNION ALL SELECT 'shared pairs', e.scope, 0, coalesce(n, 0)::DOUBLE, coalesce(n, 0) = 0 FROM (SELECT unnest(['dev & test', 'dev & train', 'test & train']) AS scope) e LEFT JOIN z USING (scope)""", "answers"),
    "ev_error_patterns": sql(f"""WITH h AS (SELECT difficulty, (spatial_type = 'topological' AND contains(prediction, '内部') AND NOT contains(reference, '内部')) AS a, (contains(prediction, '1200公里') AND NOT contains(reference, '1200')) AS b,
        (spatial_type = 'directional' AND NOT {_v2()}) AS c, NOT (length(trim(prediction)) >= 2 AND NOT starts_with(trim(prediction), 'ERROR:') AND regexp_matches(prediction, '[\\x{{4e00}}-\\x{{9fff}}0-9]')) AS d FROM answers)
        SELECT pattern, difficulty, count(*) FILTER (WHERE hit) AS n FROM (SELECT 'topological_bias' AS pattern, difficulty, a AS hit FROM h UNION ALL SELECT 'distance_bias', difficulty, b FROM h UNION ALL SELECT 'direction_confusion', difficulty, c FROM h UNION ALL SELECT 'format_issues', difficulty, d FROM h) GROUP BY ALL""", "answers"),
}
