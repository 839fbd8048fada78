"""Further figures: built-in scorers, forms of answers, azimuths, frequencies, neutral chains, layers, stored distances, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import geo, pair, record, score
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.operators import profile, sampling, split
from lodestar.plans.base import frame, pick, sql
from lodestar.plans.scoring import _v1


def _scoped(rows, *figures):
    """Figures overall, by type and by level in one aggregate."""
    out = rows.groupingSets([[], [F.col("spatial_type")], [F.col("difficulty")]], F.col("spatial_type"), F.col("difficulty")).agg(F.grouping_id().alias("g"), F.count("*").alias("total"), *figures)
    scope = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "spatial_type").otherwise("difficulty")
    return out.select(scope.alias("scope"), F.coalesce("spatial_type", "difficulty", F.lit("all")).alias("grp"), *[c for c in out.columns if c not in ("spatial_type", "difficulty", "g")])


def ev_built_in(spark, sf_dir):
    """The first version's accuracy, containment, and the built-in scorer's correctness, form and keyword F1, overall and by group."""
    p, r = F.col("prediction"), F.col("reference")
    a = frame(spark, sf_dir, "answers").select(
        "spatial_type", "difficulty", score.correct_v1(F.col("spatial_type"), p, r).alias("first"), F.contains(T.strip_stop(p), T.strip_stop(r)).alias("contained"), score.correct_by_runs(p, r).alias("runs"),
        score.valid_by_words(p).alias("form"), score.run_f1(p, r).alias("f1"),
    )
    return _scoped(a, *[F.count_if(c).alias(c) for c in ("first", "contained", "runs", "form")], F.round(F.avg("f1"), 6).alias("f1"))


def ev_answer_forms(spark, sf_dir):
    """How many predictions of each model have each form, and their share."""
    forms = [F.col("prediction").rlike(p).cast("int").alias(k) for k, p in V.ANSWER_FORMS.items()]
    rows = frame(spark, sf_dir, "answers").select("model", *forms).unpivot("model", list(V.ANSWER_FORMS), "form", "hit")
    return rows.groupBy("model", "form").agg(F.sum("hit").alias("n"), F.round(F.avg("hit"), 6).alias("share"))


def prof_azimuths(spark, sf_dir):
    """Azimuths in eighths of the circle, the last closed, beside their least, greatest, mean, median and deviation."""
    x = F.col("azimuth").cast("double")
    p = frame(spark, sf_dir, "pairs")
    whole = p.agg(*profile.moments(x)).select("least", "most", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"))
    return p.groupBy(F.least(F.floor(x / 45), F.lit(7)).cast("int").alias("eighth")).agg(F.count("*").alias("n")).crossJoin(whole)


def agg_frequency_bands(spark, sf_dir):
    """How many entities occur how often, in the bands of the audit, with their share against a target and the ratio of the two."""
    per = frame(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    band = F.when(F.col("n") <= 5, "1-5").when(F.col("n") <= 10, "6-10").when(F.col("n") <= 20, "11-20").when(F.col("n") <= 30, "21-30").otherwise("31+")
    out = profile.against_target(per.select(band.alias("band")), "band", {"1-5": 0.1, "6-10": 0.2, "11-20": 0.4, "21-30": 0.2, "31+": 0.1}, 0.05)
    return out.select("band", "n", F.round("share", 6).alias("share"), "target", F.round(F.col("share") / F.col("target"), 6).alias("ratio"), "ok")


def agg_type_sets(spark, sf_dir):
    """The set of types that each entity of the first side is paired with."""
    p = frame(spark, sf_dir, "pairs").groupBy("a").agg(F.array_join(F.array_sort(F.collect_set("b_type")), ",").alias("types"), F.count_distinct("relation").alias("relations"))
    return p


def prj_neutral_chain(spark, sf_dir):
    """Chains whose relation, action and results no longer tell the kind of the answer."""
    step = F.struct(F.col("l_linenumber").cast("int").alias("step"), F.expr(_ACTION).alias("action"), F.expr(_RELATION).alias("relation_type"), F.col("l_quantity").alias("calculation_result"))
    chains = frame(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("chain"))
    neutral = record.neutral_actions(record.neutral_relation(F.col("chain")))
    bare = record.without_leaks(F.col("chain"))
    join = lambda c, f: F.array_join(F.transform(c, lambda s: s[f]), ",")
    return chains.select("l_orderkey", join(neutral, "action").alias("actions"), join(neutral, "relation_type").alias("relations"), F.size(bare).alias("steps"))


def prj_question_relation(spark, sf_dir):
    """Relations that questions alone show, beside those stated."""
    r = frame(spark, sf_dir, "records")
    return r.groupBy(F.coalesce("relation", F.lit("none")).alias("stated"), record.relation_of_question(F.col("question")).alias("shown")).agg(F.count("*").alias("n"))


def geo_stored_distance(spark, sf_dir):
    """Stored distances held against the sphere, and directions by signs alone, by relation."""
    at = [F.col(c) for c in ("a_lon", "a_lat", "b_lon", "b_lat")]
    stored = F.expr("km % 40 * 100").cast("double")
    rows = frame(spark, sf_dir, "pairs").select("relation", geo.sign_pair(*at).alias("word"), geo.stored_distance_fits(*at, stored, 50.0).alias("fits"))
    return rows.groupBy("relation", "word").agg(F.count("*").alias("n"), F.count_if("fits").alias("fits"))


def dq_topology_words(spark, sf_dir):
    """The share of answers of each topological subtype that have a topological word, against four fifths, and whether there are four subtypes."""
    r = frame(spark, sf_dir, "records").where("relation = 'topological'")
    per = r.groupBy(F.coalesce(record.topology_label(F.col("subtype")), F.lit("none")).alias("label")).agg(F.count("*").alias("n"), F.avg(T.contains_any(F.col("answer"), V.TOPOLOGY_DEFAULT).cast("int")).alias("rate"))
    kinds = per.agg((F.count_if(F.col("label").isin(V.TOPOLOGY)) >= 4).alias("enough"))
    return per.crossJoin(kinds).select("label", "n", F.round("rate", 6).alias("rate"), (F.col("rate") >= 0.8).alias("ok"), "enough")


def dq_negative_files(spark, sf_dir):
    """Pairs whose mark does not fit the name of their file."""
    p = frame(spark, sf_dir, "pairs").withColumn("file", F.expr(_FILE)).withColumn("marked", F.expr("CASE WHEN b % 10 = 0 THEN NULL ELSE negative END"))
    return p.groupBy("file").agg(F.count("*").alias("n"), F.count_if(~pair.negative_fits(F.col("marked"), F.col("file"))).alias("odd"))


def spl_accepted(spark, sf_dir):
    """A split by layer (relation, level, topological subtype), its ratios and layers against the whole."""
    r = frame(spark, sf_dir, "records").select("id", split.layer_of().alias("layer"))
    out = split.acceptance(sampling.ratio_split(r, ["layer"]), "layer", {"train": 0.8, "dev": 0.1, "test": 0.1})
    return out.withColumns({"ratio": F.round("ratio", 6), "tvd": F.round("tvd", 6)})


def sam_topology(spark, sf_dir):
    """Quotas by relation and level with equal parts for topological subtypes, filled up to 90 rows."""
    r = frame(spark, sf_dir, "records").select("id", "relation", "difficulty", F.expr("lower(trim(subtype))").alias("subtype"))
    return sampling.topology_quota(r, {("topological", "easy"): 25, ("topological", "hard"): 11, ("metric", "medium"): 20, ("directional", "easy"): 7}, V.TOPOLOGY, 90)


def sam_overlap(spark, sf_dir):
    """What a merge of two sets with common ids adds."""
    a = frame(spark, sf_dir, "answers").select("id", "spatial_type")
    return sampling.overlap(a.where("id % 3 = 0"), a.where("id % 4 < 2"), "id")


def win_first_named(spark, sf_dir):
    """The first row of each name in order; rows whose name is blank are dropped as duplicates are."""
    rows = frame(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('N', c_custkey % 700) END AS name", "c_custkey AS line")
    named = rows.where("trim(name) <> ''")
    return named.groupBy("name").agg(F.min("line").alias("line"), (F.count("*") - 1).alias("duplicates"))


def chat_stats(spark, sf_dir):
    """Turns, lengths and conversations by role, with messages that are missing or blank."""
    n = F.char_length("text")
    c = frame(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.count_if(F.coalesce(F.trim("text") == "", F.lit(True))).alias("blank"))


_ACTION = pick("l_partkey", ["calculate_distance", "determine_topology", "calculate_direction", "classify_relation", "calculate_composite", "calculate"])
_RELATION = pick("l_suppkey", V.RELATIONS)
_FILE = pick("a", ["Negative_pairs.json", "pairs.json", "sets/negative/x.json"])
QUERIES = {
    f.__name__: f
    for f in (
        ev_built_in, ev_answer_forms, prof_azimuths, agg_frequency_bands, agg_type_sets, prj_neutral_chain, prj_question_relation, geo_stored_distance, dq_topology_words, dq_negative_files, spl_accepted, sam_topology,
        sam_overlap, win_first_named, chat_stats,
    )
}

_SCOPE = "CASE WHEN grouping(spatial_type) = 0 THEN 'spatial_type' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS scope, coalesce(spatial_type, difficulty, 'all') AS grp, count(*) AS total"
_RUNS = lambda c: f"list_distinct(regexp_extract_all({c}, '[\\x{{4e00}}-\\x{{9fff}}]+'))"
_HAS = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_SHOWN = "CASE " + " ".join(f"WHEN {_HAS('question', w)} THEN '{k}'" for k, w in V.QUESTION_RELATIONS.items()) + " ELSE 'composite' END"
_LABEL = "CASE lower(trim(subtype)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TOPOLOGY_LABELS.items()) + " ELSE lower(trim(subtype)) END"
_LAYER = "concat_ws('|', coalesce(relation, 'none'), difficulty, CASE WHEN relation = 'topological' THEN coalesce(lower(trim(subtype)), 'none') END)"
_NEUTRAL = f"CASE WHEN l_linenumber = 4 THEN CASE {_ACTION} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.NEUTRAL_ACTIONS.items()) + f" ELSE {_ACTION} END ELSE {_ACTION} END"
ORACLES = {
    "ev_built_in": sql(f"""WITH w AS (SELECT *, list_intersect({_RUNS('prediction')}, {V.RUN_WORDS}) AS pw, list_intersect({_RUNS('reference')}, {V.RUN_WORDS}) AS rw, len(list_intersect({_RUNS('prediction')}, {_RUNS('reference')})) > 0 AS runs FROM answers),
        x AS (SELECT *, CASE WHEN len(pw) + len(rw) = 0 THEN 1 ELSE 2 * len(list_intersect(pw, rw)) / (len(pw) + len(rw)) END AS f FROM w)
        SELECT {_SCOPE}, count(*) FILTER (WHERE {_v1()}) AS "first", count(*) FILTER (WHERE contains(regexp_replace(prediction, '[。.]+$', ''), regexp_replace(reference, '[。.]+$', ''))) AS contained, count(*) FILTER (WHERE runs) AS runs,
        count(*) FILTER (WHERE NOT starts_with(prediction, '[API_ERROR]') AND {_HAS('prediction', V.RUN_FORMAT_WORDS)}) AS form, round(avg(f), 6) AS f1 FROM x GROUP BY GROUPING SETS ((), (spatial_type), (difficulty))""", "answers"),
    "ev_answer_forms": sql(" UNION ALL ".join(f"SELECT model, '{k}' AS form, count(*) FILTER (WHERE regexp_matches(prediction, '{p}')) AS n, round(avg(regexp_matches(prediction, '{p}')::INT), 6) AS share FROM answers GROUP BY model" for k, p in V.ANSWER_FORMS.items()), "answers"),
    "prof_azimuths": sql("WITH w AS (SELECT min(azimuth)::DOUBLE AS least, max(azimuth)::DOUBLE AS most, round(avg(azimuth), 6) AS mean, median(azimuth)::DOUBLE AS median, round(stddev_pop(azimuth), 6) AS std FROM pairs) SELECT least(floor(azimuth / 45), 7)::INT AS eighth, count(*) AS n, w.* FROM pairs, w GROUP BY ALL", "pairs"),
    "agg_frequency_bands": """WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 30 THEN '21-30' ELSE '31+' END AS band, count(*) AS n FROM c GROUP BY 1),
        t AS (SELECT * FROM (VALUES ('1-5', 0.1::DOUBLE), ('6-10', 0.2), ('11-20', 0.4), ('21-30', 0.2), ('31+', 0.1)) v(band, target)), s AS (SELECT band, coalesce(n, 0) AS n, target, coalesce(n, 0) / (SELECT count(*) FROM c) AS share FROM t LEFT JOIN b USING (band))
        SELECT band, n, round(share, 6) AS share, target, round(share / target, 6) AS ratio, abs(share - target) <= 0.05 AS ok FROM s""",
    "agg_type_sets": sql("SELECT a, string_agg(DISTINCT b_type, ',' ORDER BY b_type) AS types, count(DISTINCT relation) AS relations FROM pairs GROUP BY a", "pairs"),
    "prj_neutral_chain": f"""SELECT l_orderkey, string_agg({_NEUTRAL}, ',' ORDER BY l_linenumber, {_ACTION}, {_RELATION}) AS actions, string_agg(CASE WHEN l_linenumber = 2 THEN 'spatial' ELSE {_RELATION} END, ',' ORDER BY l_linenumber, {_ACTION}, {_RELATION}) AS relations, count(*)::INT AS steps FROM lineitem GROUP BY l_orderkey""",
    "prj_question_relation": sql(f"SELECT coalesce(relation, 'none') AS stated, {_SHOWN} AS shown, count(*) AS n FROM records GROUP BY ALL", "records"),
    "geo_stored_distance": sql("""WITH h AS (SELECT *, pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lon - a_lon) / 2), 2) AS hav FROM pairs)
        SELECT relation, concat(CASE WHEN a_lat > b_lat THEN '北' ELSE '南' END, CASE WHEN a_lon > b_lon THEN '东' ELSE '西' END) AS word, count(*) AS n, count(*) FILTER (WHERE abs(2 * 6371.00877 * atan2(sqrt(hav), sqrt(1 - hav)) - km % 40 * 100) < 50) AS fits FROM h GROUP BY ALL""", "pairs"),
    "dq_topology_words": sql(f"""WITH p AS (SELECT coalesce({_LABEL}, 'none') AS label, count(*) AS n, avg({_HAS('answer', V.TOPOLOGY_DEFAULT)}::INT) AS rate FROM records WHERE relation = 'topological' GROUP BY 1)
        SELECT label, n, round(rate, 6) AS rate, rate >= 0.8 AS ok, (SELECT count(*) FILTER (WHERE label IN ('within', 'contains', 'adjacent', 'disjoint', 'overlap')) >= 4 FROM p) AS enough FROM p""", "records"),
    "dq_negative_files": sql(f"WITH p AS (SELECT {_FILE} AS file, CASE WHEN b % 10 = 0 THEN NULL ELSE negative END AS m FROM pairs) SELECT file, count(*) AS n, count(*) FILTER (WHERE coalesce(m, false) <> contains(lower(file), 'negative')) AS odd FROM p GROUP BY 1", "pairs"),
    "spl_accepted": sql(f"""WITH l AS (SELECT id, {_LAYER} AS layer FROM records), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY md5(concat(id, '|42')), id) AS r, count(*) OVER (PARTITION BY layer) AS n FROM l),
        s AS (SELECT layer, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM r), q AS (SELECT layer, count(*) / (SELECT count(*) FROM s) AS q FROM s GROUP BY 1),
        t AS (SELECT split, count(*) AS n FROM s GROUP BY 1), c AS (SELECT split, layer, count(*) AS k FROM s GROUP BY ALL), d AS (SELECT t.split, t.n, sum(abs(coalesce(k, 0) / t.n - q)) / 2 AS tvd FROM t CROSS JOIN q LEFT JOIN c ON c.split = t.split AND c.layer = q.layer GROUP BY ALL)
        SELECT split, n, round(n / (SELECT count(*) FROM s), 6) AS ratio, abs(n / (SELECT count(*) FROM s) - CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END) < 0.05 AS ratio_ok, round(tvd, 6) AS tvd, tvd < 0.05 AS tvd_ok FROM d""", "records"),
    "sam_topology": sql("""WITH r AS (SELECT id, relation, difficulty, lower(trim(subtype)) AS subtype FROM records), q AS (SELECT *, row_number() OVER (PARTITION BY relation, difficulty, CASE WHEN relation = 'topological' THEN subtype ELSE '-' END ORDER BY md5(concat(id, '|42')), id) AS k FROM r),
        c AS (SELECT *, CASE WHEN k <= CASE WHEN relation = 'topological' AND subtype IN ('within', 'contains', 'adjacent', 'disjoint', 'overlap') THEN CASE difficulty WHEN 'easy' THEN 5 WHEN 'hard' THEN 2 ELSE 0 END WHEN relation = 'metric' AND difficulty = 'medium' THEN 20 WHEN relation = 'directional' AND difficulty = 'easy' THEN 7 ELSE 0 END THEN 0 ELSE 1 END AS part FROM q)
        SELECT id, relation, difficulty, subtype FROM c ORDER BY part, md5(concat(id, '|42')), id LIMIT 90""", "records"),
    "sam_overlap": sql("""WITH b AS (SELECT id FROM answers WHERE id % 3 = 0), e AS (SELECT id FROM answers WHERE id % 4 < 2), s AS (SELECT count(*) AS n FROM e WHERE id IN (SELECT id FROM b))
        SELECT (SELECT count(*) FROM b) AS base, (SELECT count(*) FROM e) AS extra, n AS shared, (SELECT count(*) FROM e) - n AS added, (SELECT count(*) FROM b) + (SELECT count(*) FROM e) - n AS merged FROM s""", "answers"),
    "win_first_named": "WITH r AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('N', c_custkey % 700) END AS name, c_custkey AS line FROM customer) SELECT name, min(line) AS line, count(*) - 1 AS duplicates FROM r WHERE trim(name) <> '' GROUP BY name",
    "chat_stats": "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, count(*) FILTER (WHERE coalesce(trim(text) = '', true)) AS blank FROM conversations GROUP BY role",
}
