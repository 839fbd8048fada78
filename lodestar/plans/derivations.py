"""Queries of derived fields: geography, text and record functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import geo, record
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.operators import chat
from lodestar.operators.joins import points_in_polygons
from lodestar.operators.sampling import ranked_by
from lodestar.plans.base import frame, sql
from lodestar.plans.scoring import _any, _first, _number, _word



def _points():
    return [F.col(c) for c in ("a_lon", "a_lat", "b_lon", "b_lat")]


def geo_distance_bearing(spark, sf_dir):
    """Both distance forms, bearings, compass words, box test and grade, per pair, reduced to one row per word."""
    d, b = geo.haversine_km(*_points()), geo.bearing(*_points())
    rows = frame(spark, sf_dir, "pairs").where("a <> b").select(d.alias("d"), geo.haversine_km(*_points(), form="asin").alias("d2"), geo.haversine_km(*_points(), radius=geo.SPHERE_KM).alias("d3"), b.alias("b"), geo.planar_bearing(*_points()).alias("pb"), geo.in_box(F.col("a_lon"), F.col("a_lat"), (73.0, 120.0, 18.0, 50.0)).alias("inside"))
    rows = rows.withColumns({"word": geo.compass8(F.round("b", 6)), "grade": geo.deviation_grade(F.floor(F.col("d") / 10))})
    return rows.groupBy("word", "grade").agg(F.count("*").alias("n"), F.round(F.sum("d"), 3).alias("km"), F.round(F.sum("d2"), 3).alias("km_asin"), F.round(F.sum("d3"), 3).alias("km_sphere"), F.round(F.sum("pb"), 3).alias("planar"), F.count_if("inside").alias("inside"))


_GEO_CTE = """WITH h AS (SELECT *, pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lon - a_lon) / 2), 2) AS hav FROM pairs WHERE a <> b),
 g AS (SELECT *, 2 * 6371.0 * atan2(sqrt(hav), sqrt(1 - hav)) AS d, 2 * 6371.0 * asin(least(1.0, sqrt(hav))) AS d2, 2 * 6371.00877 * atan2(sqrt(hav), sqrt(1 - hav)) AS d3,
 fmod(degrees(atan2(sin(radians(b_lon - a_lon)) * cos(radians(b_lat)), cos(radians(a_lat)) * sin(radians(b_lat)) - sin(radians(a_lat)) * cos(radians(b_lat)) * cos(radians(b_lon - a_lon)))) + 360.0, 360.0) AS brg,
 fmod(degrees(atan2(b_lon - a_lon, b_lat - a_lat)) + 360.0, 360.0) AS pb FROM h)"""


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def geo_compass(spark, sf_dir):
    """All compass roundings of whole and half azimuths."""
    x = (F.col("azimuth") + F.when(F.col("km") % 2 == 0, 0.5).otherwise(0.0)).cast("double")
    return frame(spark, sf_dir, "pairs").groupBy(x.alias("x")).agg(F.count("*").alias("n")).select("x", "n", geo.compass8(F.col("x")).alias("c8"), geo.compass8(F.col("x"), "half_even").alias("c8_even"), geo.compass16(F.col("x")).alias("c16"))


def geo_sign_direction(spark, sf_dir):
    one = geo.sign_direction(*_points())
    return frame(spark, sf_dir, "pairs").groupBy(one.alias("word")).agg(F.count("*").alias("n"))


def geo_compatible_words(spark, sf_dir):
    """Pairs of the direction words of reference and prediction, how many answers have them, and whether they go together."""
    one, two = (T.first_word(F.col(c), V.PARTIAL_FIRST) for c in ("reference", "prediction"))
    words = frame(spark, sf_dir, "answers").groupBy(one.alias("one"), two.alias("two")).agg(F.count("*").alias("n")).where("one IS NOT NULL AND two IS NOT NULL")
    return words.select("one", "two", "n", geo.compatible_directions(F.col("one"), F.col("two")).alias("ok"))


_GO = " OR ".join(["one = two", *[f"(one IN ({w}) AND two IN ({w}))" for w in (", ".join(map(repr, x)) for x in V.DIRECTION_ALIASES + V.PARTIAL_DIRECTIONS)], *[f"({a} = '{k}' AND {b} IN ({', '.join(map(repr, x))}))" for k, x in V.MAIN_DIRECTIONS.items() for a, b in (("one", "two"), ("two", "one"))]])
_DIRECTION_WORD = lambda c: "CASE " + " ".join(f"WHEN contains({c}, '{w}') THEN '{w}'" for w in V.PARTIAL_FIRST) + " END"


def geo_points_in_boxes(spark, sf_dir):
    """Entities in boxes around suppliers, by cell join and exact test."""
    e = frame(spark, sf_dir, "entities").select("entity_id", "lon", "lat")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x, y = 73.033 + F.col("s_suppkey") * 41 % 600 / 10, 18.033 + F.col("s_suppkey") * 29 % 340 / 10
    boxes = s.select("s_suppkey", geo.box_ring(x, y, x + 2.5, y + 1.5).alias("ring"))
    return points_in_polygons(e, boxes, "lon", "lat", "ring").select("entity_id", "s_suppkey")


def prj_records(spark, sf_dir):
    """Inferred relation and difficulty, score, level, labels, tokens and region of every record."""
    c = F.col
    types = F.array("type1", "type2")
    return frame(spark, sf_dir, "records").select(
        "id", record.infer_relation(c("question"), c("answer")).alias("inferred"), record.infer_difficulty(c("n_entities"), c("length")).alias("level"),
        record.estimate_difficulty(c("question"), c("answer")).alias("estimate"), F.round(record.difficulty_score(c("relation"), record.topology_label(c("subtype")), F.transform(types, record.entity_type)), 6).alias("theory"),
        record.level_of(c("score")).alias("scored_level"), record.topology_label(c("subtype")).alias("label"), record.entity_type(c("type2")).alias("type"),
        record.fill_subtype(c("subtype"), c("answer")).alias("filled"), record.region_of(c("lon1"), c("lat1")).alias("region"),
        F.array_join(record.spatial_tokens(F.array_compact(F.array("name1", "name2")), c("question"), c("answer")), ",").alias("tokens"),
        F.round(record.score_of_level(c("difficulty"), c("relation"), c("subtype"), F.when(c("id") % 2 == 0, c("score"))), 6).alias("made_score"),
    )


def _case(col: str, table: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + " END"


_LABEL = f"coalesce({_case('lower(trim(subtype))', V.TOPOLOGY_LABELS)}, lower(trim(subtype)))"
_TYPE = lambda c: f"coalesce({_case(c, V.ENTITY_TYPES)}, {c})"
_BOTH = "concat(question, ' ', answer)"
_PAIR = f"concat(least({_TYPE('type1')}, {_TYPE('type2')}), '|', greatest({_TYPE('type1')}, {_TYPE('type2')}))"
_RECORDS_SQL = f"""SELECT id, coalesce({_first('lower(' + _BOTH + ')', {'metric': V.INFER_METRIC, 'topological': V.INFER_TOPOLOGY, 'directional': V.INFER_DIRECTION})}, 'composite') AS inferred,
 CASE WHEN n_entities >= 3 OR length > 300 THEN 'hard' WHEN n_entities = 2 AND length > 150 THEN 'medium' ELSE 'easy' END AS level,
 CASE WHEN p <= 1 THEN 'easy' WHEN p <= 3 THEN 'medium' ELSE 'hard' END AS estimate,
 round(least(greatest(coalesce({_case('relation', V.BASE_SCORES)}, 2.0) + coalesce({_case(_LABEL, V.TOPOLOGY_BONUS)}, 0.0) + coalesce({_case(_PAIR, {'|'.join(sorted(k)): v for k, v in V.PAIR_BONUS.items()})}, 0.5), 1.0), 5.0)::DOUBLE, 6) AS theory,
 CASE WHEN score <= 1.3 THEN 'easy' WHEN score <= 3.1 THEN 'medium' ELSE 'hard' END AS scored_level, {_LABEL} AS label, {_TYPE('type2')} AS type,
 coalesce(nullif(subtype, ''), {_first('answer', {'within': ['包含', '位于...内'], 'disjoint': ['相离', '不包含'], 'adjacent': ['相邻', '接壤'], 'overlap': ['重叠']})}, 'disjoint') AS filled,
 CASE WHEN lon1 < 105 AND lat1 < 35 THEN '西南' WHEN lon1 < 105 THEN '西北'
  WHEN lon1 < 110 AND lat1 > 42 THEN '西北' WHEN lon1 < 110 AND lat1 > 35 THEN '华北' WHEN lon1 < 110 THEN '西南'
  WHEN lon1 < 122 AND lat1 > 42 THEN '东北' WHEN lon1 < 122 AND lat1 > 35 THEN '华北' WHEN lon1 < 115 THEN '华中'
  WHEN lon1 < 122 AND lat1 > 28 THEN '华东' WHEN lon1 < 122 THEN '东南' WHEN lat1 > 42 THEN '东北' WHEN lat1 > 30 THEN '华东' ELSE '东南' END AS region,
 array_to_string(list_sort(list_distinct(list_filter(list_concat([name1, name2], list_filter({_list(V.TOKEN_WORDS)}, lambda w: contains({_BOTH}, w))), lambda x: x IS NOT NULL)))[1:8], ',') AS tokens,
 round(CASE WHEN id % 2 = 0 THEN score ELSE round_even(least(greatest(coalesce({_case('difficulty', V.LEVEL_BASE)}, 2.75) + 0.5 * (coalesce({_case('relation', V.BASE_SCORES)}, 2.0) - 1) + 0.3 * coalesce({_case('subtype', V.TOPOLOGY_BONUS)}, 0.0), 1.0), 5.0)::DOUBLE, 1) END, 6) AS made_score
 FROM (SELECT *, (length(question) > 100)::INT + (length(question) > 200)::INT + (length(answer) > 200)::INT + {' + '.join(f"contains(question, '{w}')::INT" for w in V.COMPLEX_WORDS)} AS p FROM records)"""


#: The target relation that each relation of the pair table stands for here.
TARGETS = {
    "geo.contains": "topological.contains", "geo.touches": "topological.adjacent", "geo.metric": "metric.distance", "geo.direction": "directional.azimuth",
    "geo.direction_distance": "composite.directional_metric", "geo.intersects": "topological.crosses", "geo.disjoint": "composite.sameside",
}


def prj_pair_names(spark, sf_dir):
    c = F.col
    rows = frame(spark, sf_dir, "pairs").select(record.short_relation(c("relation"), c("negative")).alias("short"), record.relation_category(T.lookup(c("relation"), TARGETS)).alias("category"), record.id_prefix(c("pair_id")).alias("prefix"), record.id_number(c("pair_id")).alias("number"))
    return rows.groupBy("short", "category", "prefix").agg(F.count("*").alias("n"), F.max("number").alias("most"))


def prj_renumber(spark, sf_dir):
    """New ids per type in the order of the old ones."""
    e = ranked_by(frame(spark, sf_dir, "entities").select("entity_id", "type"), ["type"], [F.col("entity_id")], "number")
    return e.selectExpr("entity_id", "format_string('%s_%04d', lower(type), number) as new_id")


def str_extract(spark, sf_dir):
    """Numbers, distances, directions and coordinates in answers and questions."""
    a = F.col("answer")
    q = F.col("question")
    rows = frame(spark, sf_dir, "records")
    return rows.select(
        "id", T.distance_in_text(a).alias("km"), T.distance_with_unit(a).alias("km_unit"), T.first_number(q).alias("number"), F.size(T.numbers(q)).cast("long").alias("numbers"),
        T.first_word(a, V.PARTIAL_FIRST).alias("direction"), T.has_coordinates(q).alias("placed"), T.without_bias(q).alias("rewritten"), T.strip_stop(F.concat(a, F.lit("。."))).alias("stripped"),
        F.array_join(T.char_ngrams(a, 2), "|").alias("grams"), T.longest_prefix(F.col("name1"), q).alias("prefix"), T.span(F.col("name2"), q)["char_start"].alias("start"),
        F.array_join(T.name_variants(F.concat("name1", F.lit("市")), {"城市1市": ["一城"]}), ",").alias("variants"), T.pair_key(F.array_compact(F.array("name1", "name2"))).alias("pair"),
    )


def _rules_sql(col: str) -> str:
    for p, r in V.BIAS_RULES:
        col = f"regexp_replace({col}, '{p}', '{r.replace('{1}', chr(92) + '1')}', 'g')"
    return col


_STR_SQL = f"""SELECT id, coalesce({', '.join(f"TRY_CAST(nullif(regexp_extract(answer, '{p}', 1), '') AS DOUBLE)" for p in V.DISTANCE_PATTERNS)}) AS km,
 coalesce({', '.join(f"TRY_CAST(nullif(regexp_extract(answer, '{p}', 1), '') AS DOUBLE) * {k}" for p, k in V.UNIT_PATTERNS)}) AS km_unit,
 {_number('question')} AS number, len(regexp_extract_all(question, '\\d+(?:\\.\\d+)?'))::BIGINT AS numbers, {_word('answer', V.PARTIAL_FIRST)} AS direction,
 regexp_matches(question, '{'|'.join('(?:' + p + ')' for p in V.COORDINATE_PATTERNS)}') AS placed, {_rules_sql('question')} AS rewritten, regexp_replace(concat(answer, '。.'), '[。.]+$', '') AS stripped,
 array_to_string(list_transform(range(1, greatest(length(answer), 1)::BIGINT), lambda i: substr(answer, i, 2)), '|') AS grams,
 (SELECT max(p) FROM (SELECT substr(name1, 1, k) AS p FROM (SELECT unnest(range(1, length(name1) + 1)) AS k)) WHERE contains(question, p)) AS prefix,
 CASE WHEN name2 IS NOT NULL AND instr(question, name2) > 0 THEN instr(question, name2) - 1 END AS start,
 CASE WHEN name1 = '城市1' THEN '城市1市,一城,城市1' ELSE concat(name1, '市,', name1) END AS variants,
 CASE WHEN name2 IS NOT NULL THEN concat(least(name1, name2), '|', greatest(name1, name2)) END AS pair FROM records"""


def chat_conversations(spark, sf_dir):
    out = chat.conversations(frame(spark, sf_dir, "conversations"))
    return out.select("conv_id", F.size("messages").cast("long").alias("turns"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n")).alias("digest"))


def chat_messages(spark, sf_dir):
    """Records as three messages; empty answers are dropped."""
    r = frame(spark, sf_dir, "records").withColumn("answer", F.when(F.col("id") % 7 != 0, F.col("answer")).otherwise(F.lit("")))
    return chat.from_any(r.select("id", "question", "answer"), "你是地理专家。").select("id", F.to_json("messages").alias("messages"))


def events_props(spark, sf_dir):
    """A field of the JSON properties by event type."""
    return frame(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k"), F.count_if(F.col("props").contains("k")).alias("with_k"))


QUERIES = {
    f.__name__: f
    for f in (geo_distance_bearing, geo_compass, geo_sign_direction, geo_compatible_words, geo_points_in_boxes, prj_records, prj_pair_names, prj_renumber, str_extract, chat_conversations, chat_messages, events_props)
}
_C8, _C16, _W20 = _list(V.COMPASS_8), _list(V.COMPASS_16), _list(V.DIRECTIONS_20)
ORACLES = {
    "geo_distance_bearing": sql(
        _GEO_CTE + f""" SELECT {_C8}[floor((round(brg, 6) + 22.5) / 45)::INT % 8 + 1] AS word, CASE WHEN floor(d / 10) <= 10 THEN 'correct' WHEN floor(d / 10) <= 50 THEN 'minor' ELSE 'incorrect' END AS grade,
        count(*) AS n, round(sum(d), 3) AS km, round(sum(d2), 3) AS km_asin, round(sum(d3), 3) AS km_sphere, round(sum(pb), 3) AS planar, count(*) FILTER (WHERE a_lon BETWEEN 73 AND 120 AND a_lat BETWEEN 18 AND 50) AS inside FROM g GROUP BY ALL""", "pairs"),
    "geo_compass": sql(
        f"""WITH x AS (SELECT (azimuth + CASE WHEN km % 2 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS x, count(*) AS n FROM pairs GROUP BY 1)
        SELECT x, n, {_C8}[floor((x + 22.5) / 45)::INT % 8 + 1] AS c8, {_C8}[round_even(x / 45, 0)::INT % 8 + 1] AS c8_even, {_C16}[floor((x + 11.25) / 22.5)::INT % 16 + 1] AS c16 FROM x""", "pairs"),
    "geo_sign_direction": sql(
        """WITH w AS (SELECT concat(CASE WHEN b_lon - a_lon > 1 THEN '东' WHEN b_lon - a_lon < -1 THEN '西' ELSE '' END, CASE WHEN b_lat - a_lat > 1 THEN '北' WHEN b_lat - a_lat < -1 THEN '南' ELSE '' END) AS w FROM pairs)
        SELECT CASE WHEN w = '' THEN '邻近' ELSE w END AS word, count(*) AS n FROM w GROUP BY 1""", "pairs"),
    "geo_compatible_words": sql(f"""WITH w AS (SELECT {_DIRECTION_WORD('reference')} AS one, {_DIRECTION_WORD('prediction')} AS two, count(*) AS n FROM answers GROUP BY ALL)
        SELECT one, two, n, {_GO} AS ok FROM w WHERE one IS NOT NULL AND two IS NOT NULL""", "answers"),
    "geo_points_in_boxes": sql(
        """WITH b AS (SELECT s_suppkey, 73.033 + (s_suppkey * 41 % 600)::DOUBLE / 10 AS x, 18.033 + (s_suppkey * 29 % 340)::DOUBLE / 10 AS y FROM supplier)
        SELECT entity_id, s_suppkey FROM entities, b WHERE lon > x AND lon < x + 2.5 AND lat > y AND lat < y + 1.5""", "entities"),
    "prj_records": sql(_RECORDS_SQL, "records"),
    "prj_pair_names": sql(
        """SELECT CASE WHEN negative THEN concat('negative_', split_part(relation, '.', 2)) ELSE split_part(relation, '.', 2) END AS short,
        CASE relation WHEN 'geo.contains' THEN 'C1' WHEN 'geo.touches' THEN 'C2' WHEN 'geo.metric' THEN 'metric' WHEN 'geo.disjoint' THEN 'C4' WHEN 'geo.intersects' THEN 'unknown' ELSE 'directional' END AS category,
        split_part(pair_id, '_', 1) AS prefix, count(*) AS n, max(split_part(pair_id, '_', 3)::BIGINT) AS most FROM pairs GROUP BY ALL""", "pairs"),
    "prj_renumber": sql("SELECT entity_id, format('{}_{:04d}', lower(type), row_number() OVER (PARTITION BY type ORDER BY entity_id)) AS new_id FROM entities", "entities"),
    "str_extract": sql(_STR_SQL, "records"),
    "chat_conversations": "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn, role, text) AS roles, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    "chat_messages": sql(
        """SELECT id, concat('[{"role":"system","content":"你是地理专家。"},{"role":"user","content":"', question, '"},{"role":"assistant","content":"', answer, '"}]') AS messages FROM records WHERE id % 7 <> 0""", "records"),
    "events_props": "SELECT event_type, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) FILTER (WHERE contains(props, 'k')) AS with_k FROM events GROUP BY ALL",
}
