"""Further queries: polygon predicates, dataset versions, repairs, and geometry checks of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import geo, polygon, record, score
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.operators import joins, sampling
from lodestar.plans.base import frame, pick, sql
from lodestar.plans.derivations import _DIRECTION_WORD, _GO


def geo_box_predicates(spark, sf_dir):
    """Topological predicates between two boxes of every order key, on whole-number corners; boxes that come again are compared once."""
    x = lambda k, m: (F.col("k") * k % m).cast("double")
    k = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")).distinct()
    corners = {"a0": x(7, 9), "b0": x(5, 8), "a1": x(7, 9) + 1 + x(3, 5), "b1": x(5, 8) + 1 + x(11, 4), "c0": x(13, 10), "d0": x(17, 7), "c1": x(13, 10) + 1 + x(19, 6), "d1": x(17, 7) + 1 + x(23, 5)}
    a, b = (geo.box_ring(*map(F.col, names)) for names in (("a0", "b0", "a1", "b1"), ("c0", "d0", "c1", "d1")))
    rings = F.when(F.col("one"), F.array(a)).otherwise(F.array(a, b))
    facts = {"apart": polygon.disjoint(a, b), "touches": polygon.touches(a, b), "contains": polygon.contains(a, b), "within": polygon.contains(b, a), "points": polygon.n_points(rings), "centre": polygon.contains_centroid(a, b)}
    rows = k.select("k", (F.col("k") % 3 == 0).alias("one"), *[c.alias(n) for n, c in corners.items()])
    return joins.with_once(rows, ["one", *corners], facts).select("k", *facts)


#: The direction that a record states, of the first entity seen from the second.
_SAID = pick("length", ["东", "东北方", "南", "西南", "北偏东", "西", "东南", "北", "正南", "西北"])


def geo_answers(spark, sf_dir):
    """Stated distance and direction against the positions, by the true direction of the first entity from the second."""
    c = F.col
    rows = frame(spark, sf_dir, "records").withColumn("answer", F.concat("answer", F.lit("，位于"), F.expr(_SAID)))
    km = geo.haversine_km(c("lon1"), c("lat1"), c("lon2"), c("lat2"))
    stated, word = T.distance_in_text(c("answer")), T.first_word(F.substring_index("answer", "，", -1), V.PARTIAL_FIRST)
    back = geo.compass8(F.round(geo.planar_bearing(c("lon2"), c("lat2"), c("lon1"), c("lat1")), 6))
    forth = geo.compass8(F.round(geo.planar_bearing(c("lon1"), c("lat1"), c("lon2"), c("lat2")), 6))
    return rows.groupBy(back.alias("seen_from_second"), forth.alias("seen_from_first")).agg(
        F.count("*").alias("n"), F.count_if(F.abs(stated - km) <= km * 0.10).alias("within_tenth"), F.count_if(F.abs(stated - km) <= 50).alias("within_50"),
        F.count_if(word == back).alias("same_direction"), F.count_if(geo.compatible_directions(back, word)).alias("direction_fits"),
    )


def prj_versions(spark, sf_dir):
    """Questions without coordinates and with a coordinate prefix."""
    q = F.col("question")
    prefix = F.format_string("已知%s(%.2f,%.2f)，", "name1", "lon1", "lat1")
    return frame(spark, sf_dir, "records").select("id", T.without_coordinates(q).alias("without"), F.concat(prefix, q).alias("with_prefix"), T.inline_coordinates(q, F.array(F.struct(F.col("name1").alias("name"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat")))).alias("inlined"))


def prj_repair(spark, sf_dir):
    """Defaults for missing or odd fields, with the codes of the repairs made."""
    c = F.col
    fixes = {
        "relation_inferred": c("relation").isNull(), "label_mapped": c("subtype") != record.topology_label(c("subtype")), "subtype_dropped": c("subtype").isNotNull() & ~(c("relation") == "topological"),
        "type_mapped": c("type2") != record.entity_type(c("type2")), "score_clamped": c("score") > 5,
    }
    codes = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in fixes.items()]))
    rows = frame(spark, sf_dir, "records").select("id", codes.alias("codes"), F.coalesce("relation", record.infer_relation(c("question"), c("answer"))).alias("relation"))
    return rows.select("id", F.array_join("codes", ",").alias("codes"), "relation")


def prj_normalised_chain(spark, sf_dir):
    """Chains of five steps with placeholders, from conversations."""
    turns = frame(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("step"), F.coalesce("text", F.lit("")).alias("content")))).alias("chain"))
    five = record.five_steps(F.col("chain"))
    return turns.select("conv_id", F.size(five).alias("steps"), F.md5(F.array_join(F.transform(five, lambda s: s["content"]), "|")).alias("digest"))


def dq_extremes(spark, sf_dir):
    """Zero-length, same-type and reflexive pairs, by relation."""
    same_place = (F.col("a_lon") == F.col("b_lon")) & (F.col("a_lat") == F.col("b_lat"))
    return frame(spark, sf_dir, "pairs").groupBy("relation").agg(F.count_if(F.col("a") == F.col("b")).alias("reflexive"), F.count_if(same_place & (F.col("a") != F.col("b"))).alias("same_place"), F.count_if(F.col("a_type") == F.col("b_type")).alias("same_type"), F.min("km").alias("shortest"))


def dq_bias_patterns(spark, sf_dir):
    """Questions with leading phrases by pattern and relation."""
    patterns = {"judge": "请判断", "ask": "请问", "estimate": "请估算", "view": "从.{1,10}关系来看", "coordinates": "[北南]纬"}
    r = frame(spark, sf_dir, "records").select(F.coalesce("relation", F.lit("none")).alias("relation"), *[F.col("question").rlike(p).cast("int").alias(k) for k, p in patterns.items()])
    return r.unpivot("relation", list(patterns), "pattern", "hit").groupBy("relation", "pattern").agg(F.sum("hit").alias("n"))


def ev_bleu_simple(spark, sf_dir):
    """Unigram precision with a length factor, and the mean of precisions without penalty."""
    p, r = F.col("prediction"), F.col("reference")
    one = score.bleu(p, r, order=1)
    length = F.least(F.lit(1.0), F.char_length(p) / F.char_length(r))
    chars = lambda c: F.split(c, "")
    hits = F.aggregate(F.array_distinct(chars(p)), F.lit(0), lambda a, g: a + F.least(F.size(F.filter(chars(p), lambda x: x == g)), F.size(F.filter(chars(r), lambda x: x == g))))
    return frame(spark, sf_dir, "answers").select("id", F.round(hits / F.char_length(p) * length, 6).alias("simple"), F.round(one, 6).alias("unigram"))


def ev_character_overlap(spark, sf_dir):
    """Jaccard similarity of character sets and change of length between two models, by type."""
    chars = lambda c: F.array_distinct(F.split(c, ""))
    a, b = chars(F.col("prediction")), chars(F.col("other"))
    rows = frame(spark, sf_dir, "answers").select("spatial_type", (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("alike"), (F.char_length("other") - F.char_length("prediction")).alias("change"))
    return rows.groupBy("spatial_type").agg(F.round(F.avg("alike"), 6).alias("alike"), F.sum("change").alias("change"))


def chat_split(spark, sf_dir):
    """Conversations split 80/10/10 with their number of turns."""
    t = frame(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns"))
    return sampling.ratio_split(t, [])


def agg_text_stats(spark, sf_dir):
    """Mean lengths and coverage by source, in one pass over labels joined to documents."""
    d = frame(spark, sf_dir, "documents").join(frame(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.round(F.avg(F.octet_length("text")), 6).alias("bytes"), F.round(F.avg("quality"), 6).alias("quality"))


def stream_shapes(spark, sf_dir):
    """Events per hour and type, the batch form of the tumbling-window stream."""
    e = frame(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "value")


QUERIES = {
    f.__name__: f
    for f in (geo_box_predicates, geo_answers, prj_versions, prj_repair, prj_normalised_chain, dq_extremes, dq_bias_patterns, ev_bleu_simple, ev_character_overlap, chat_split, agg_text_stats, stream_shapes)
}
_LABELS = "CASE lower(trim(subtype)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TOPOLOGY_LABELS.items()) + " ELSE lower(trim(subtype)) END"
_TYPES = "CASE type2 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ENTITY_TYPES.items()) + " ELSE type2 END"
_D8 = "['" + "', '".join(V.COMPASS_8) + "']"
_PB = "floor((round(fmod(degrees(atan2({0}, {1})) + 360, 360), 6) + 22.5) / 45)::INT % 8 + 1"


def _without(col: str) -> str:
    for p in V.COORDINATE_REMOVALS:
        col = f"regexp_replace({col}, '{p}', '', 'g')"
    return col


_INFER = "CASE WHEN {m} THEN 'metric' WHEN {t} THEN 'topological' WHEN {d} THEN 'directional' ELSE 'composite' END".format(
    **{k: "(" + " OR ".join(f"contains(concat(question, ' ', answer), '{w}')" for w in words) + ")" for k, words in (("m", V.INFER_METRIC), ("t", V.INFER_TOPOLOGY), ("d", V.INFER_DIRECTION))}
)
ORACLES = {
    "geo_box_predicates": """WITH k AS (SELECT DISTINCT o_orderkey AS k FROM orders), x AS (SELECT k, k*7%9 AS a0, k*5%8 AS b0, k*7%9+1+k*3%5 AS a1, k*5%8+1+k*11%4 AS b1, k*13%10 AS c0, k*17%7 AS d0, k*13%10+1+k*19%6 AS c1, k*17%7+1+k*23%5 AS d1 FROM k)
        SELECT k, a1 < c0 OR c1 < a0 OR b1 < d0 OR d1 < b0 AS apart, NOT (a1 < c0 OR c1 < a0 OR b1 < d0 OR d1 < b0) AND (a1 = c0 OR c1 = a0 OR b1 = d0 OR d1 = b0) AS touches,
        a0 <= c0 AND a1 >= c1 AND b0 <= d0 AND b1 >= d1 AS contains, c0 <= a0 AND c1 >= a1 AND d0 <= b0 AND d1 >= b1 AS within, CASE WHEN k % 3 = 0 THEN 5 ELSE 10 END AS points, (c0 + c1) / 2 > a0 AND (c0 + c1) / 2 < a1 AND (d0 + d1) / 2 > b0 AND (d0 + d1) / 2 < b1 AS centre FROM x""",
    "geo_answers": sql(f"""WITH r AS (SELECT *, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS h, {_DIRECTION_WORD(_SAID)} AS two,
        {_D8}[{_PB.format('lon1 - lon2', 'lat1 - lat2')}] AS one, {_D8}[{_PB.format('lon2 - lon1', 'lat2 - lat1')}] AS forth,
        coalesce(TRY_CAST(nullif(regexp_extract(answer, '约(\\d+\\.?\\d*)\\s*公里', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(answer, '(\\d+\\.?\\d*)\\s*公里', 1), '') AS DOUBLE)) AS stated FROM records), s AS (SELECT *, 12742 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM r)
        SELECT one AS seen_from_second, forth AS seen_from_first, count(*) AS n, count(*) FILTER (WHERE abs(stated - km) <= km * 0.10) AS within_tenth, count(*) FILTER (WHERE abs(stated - km) <= 50) AS within_50,
        count(*) FILTER (WHERE one = two) AS same_direction, count(*) FILTER (WHERE {_GO}) AS direction_fits FROM s GROUP BY ALL""", "records"),
    "prj_versions": sql(f"SELECT id, {_without('question')} AS without, concat('已知', name1, printf('(%.2f,%.2f)，', lon1, lat1), question) AS with_prefix, replace(question, name1, concat(name1, printf('(%.4f,%.4f)', lon1, lat1))) AS inlined FROM records", "records"),
    "prj_repair": sql(f"""SELECT id, concat_ws(',', CASE WHEN relation IS NULL THEN 'relation_inferred' END, CASE WHEN subtype <> {_LABELS} THEN 'label_mapped' END, CASE WHEN subtype IS NOT NULL AND NOT (relation = 'topological') THEN 'subtype_dropped' END,
        CASE WHEN type2 <> {_TYPES} THEN 'type_mapped' END, CASE WHEN score > 5 THEN 'score_clamped' END) AS codes, coalesce(relation, {_INFER}) AS relation FROM records""", "records"),
    "prj_normalised_chain": """WITH r AS (SELECT conv_id, coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS k FROM conversations), c AS (SELECT DISTINCT conv_id FROM conversations), g AS (SELECT conv_id, unnest([1, 2, 3, 4, 5]) AS k FROM c)
        SELECT conv_id, 5 AS steps, md5(string_agg(coalesce(content, ''), '|' ORDER BY k)) AS digest FROM g LEFT JOIN r USING (conv_id, k) GROUP BY conv_id""",
    "dq_extremes": sql("SELECT relation, count(*) FILTER (WHERE a = b) AS reflexive, count(*) FILTER (WHERE a_lon = b_lon AND a_lat = b_lat AND a <> b) AS same_place, count(*) FILTER (WHERE a_type = b_type) AS same_type, min(km) AS shortest FROM pairs GROUP BY relation", "pairs"),
    "dq_bias_patterns": sql(" UNION ALL ".join(f"SELECT coalesce(relation, 'none') AS relation, '{k}' AS pattern, count(*) FILTER (WHERE regexp_matches(question, '{p}')) AS n FROM records GROUP BY ALL" for k, p in {"judge": "请判断", "ask": "请问", "estimate": "请估算", "view": "从.{1,10}关系来看", "coordinates": "[北南]纬"}.items()), "records"),
    "ev_bleu_simple": sql("""WITH c AS (SELECT id, side, g, count(*) AS c FROM (SELECT id, 'p' AS side, unnest(string_split(prediction, '')) AS g FROM answers UNION ALL SELECT id, 'r', unnest(string_split(reference, '')) FROM answers) GROUP BY ALL),
        h AS (SELECT p.id, sum(least(p.c, r.c)) AS h FROM c p JOIN c r ON p.id = r.id AND p.g = r.g AND p.side = 'p' AND r.side = 'r' GROUP BY p.id)
        SELECT id, round(coalesce(h, 0) / length(prediction) * least(1.0, length(prediction) / length(reference)), 6) AS simple, round(coalesce(h, 0) / length(prediction) * CASE WHEN length(prediction) <= length(reference) THEN exp(1 - length(reference) / length(prediction)) ELSE 1 END, 6) AS unigram FROM answers LEFT JOIN h USING (id)""", "answers"),
    "ev_character_overlap": sql("WITH c AS (SELECT spatial_type, list_distinct(string_split(prediction, '')) AS a, list_distinct(string_split(other, '')) AS b, length(other) - length(prediction) AS d FROM answers) SELECT spatial_type, round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) AS alike, sum(d)::BIGINT AS change FROM c GROUP BY 1", "answers"),
    "chat_split": "WITH t AS (SELECT conv_id AS id, count(*) AS turns FROM conversations GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY md5(concat(id, '|42')), id) AS r, count(*) OVER () AS n FROM t) SELECT id, turns, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM r",
    "agg_text_stats": "SELECT source, count(*) AS n, count(quality) AS labelled, round(avg(octet_length(encode(text))), 6) AS bytes, round(avg(quality), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "stream_shapes": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
