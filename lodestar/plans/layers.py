"""Queries of chain audits, pair-layer audits, and further splits and samples, with the SQL that states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import chain, pair, record
from lodestar.functions import vocabulary as V
from lodestar.operators import facts, names, quality, sampling
from lodestar.operators.quality import Rule
from lodestar.plans.base import frame, pick, sql

#: One row per step of a record's chain: which fields it has, and a place that it states with the known one. SQL of both engines.
_STEPS = {
    "id": "l_orderkey", "step": "l_linenumber", "h_name": "l_partkey % 11 > 0", "h_action": "l_suppkey % 13 > 0", "h_content": "(l_partkey + l_suppkey) % 17 > 0", "h_own": "l_partkey % 7 > 0",
    "place": "concat('P', l_partkey % 50)", "known_lon": "73.0 + l_partkey % 50", "known_lat": "18.0 + l_partkey % 50 % 30",
    "lon": "73.0 + l_partkey % 50 + (l_suppkey % 30) * 0.0007", "lat": "18.0 + l_partkey % 50 % 30 + (l_partkey % 23) * 0.0007", "known": "l_partkey % 9 > 0", "mapped": "l_partkey % 50 % 6 > 0",
}


def _chains(spark, sf_dir):
    """Records with a chain of maps, stated and known places, names, and a token map."""
    s = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} AS {n}" for n, e in _STEPS.items()])
    # one row per record and step: the least of all columns
    s = s.groupBy("id", "step").agg(F.min(F.struct(*[c for c in _STEPS if c not in ("id", "step")])).alias("r")).select("id", "step", "r.*")
    own = F.coalesce(*[F.when(F.col("step") == k, F.lit(v)) for k, v in V.STEP_EXTRA.items()], F.lit("more"))
    has = F.array_compact(F.array(F.lit("step"), F.when(F.col("h_name"), "name"), F.when(F.col("h_action"), "action"), F.when(F.col("h_content"), "content"), F.when(F.col("h_own"), own)))
    fields = F.map_from_arrays(has, F.transform(has, lambda x: F.concat(x, F.lit("!"))))
    steps = F.array_sort(F.collect_list(F.struct("step", F.map_entries(fields).alias("fields"), "place", F.array("lon", "lat").alias("said"), F.array("known_lon", "known_lat").alias("known"), F.col("known").alias("is_known"), "mapped")))
    g = s.groupBy("id").agg(steps.alias("s"))
    first = lambda pairs: F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<k:string,v:array<double>>>"), lambda a, e: F.when(F.exists(a, lambda x: x["k"] == e["k"]), a).otherwise(F.array_append(a, e))))
    entry = lambda x, v: F.struct(x["place"].alias("k"), F.transform(x[v], lambda y: y.cast("double")).alias("v"))
    return g.select(
        "id", F.transform("s", lambda x: F.map_from_entries(x["fields"])).alias("chain"), F.transform("s", lambda x: x["place"]).alias("names"),
        first(F.transform("s", lambda x: entry(x, "said"))).alias("said"), first(F.transform(F.filter("s", lambda x: x["is_known"]), lambda x: entry(x, "known"))).alias("known"),
        first(F.transform(F.filter("s", lambda x: x["mapped"]), lambda x: entry(x, "known"))).alias("tokens"),
    )


def dq_chains(spark, sf_dir):
    """What is wrong with each record's chain: length, first incomplete step, leaks, displaced places, unmapped names."""
    return _chains(spark, sf_dir).select(
        "id", F.size("chain").cast("long").alias("steps"), chain.has_length(F.col("chain")).alias("five"), F.array_min(chain.gaps(F.col("chain"))).alias("first_gap"), chain.leaks(F.col("chain")).alias("leaks"),
        chain.is_whole(F.col("chain")).alias("whole"), F.array_join(F.array_sort(chain.displaced(F.col("said"), F.col("known"))), ",").alias("displaced"),
        F.array_join(F.array_sort(chain.unmapped(F.col("names"), F.col("tokens"))), ",").alias("unmapped"),
    )


def dq_chain_rates(spark, sf_dir):
    """The chain checks as rules with their least rates."""
    rows = dq_chains(spark, sf_dir)
    rules = [
        Rule("chain_length", F.col("five"), "important", 2, least_rate=0.95), Rule("chain_fields", F.col("first_gap").isNull(), "important", 2, least_rate=0.95), Rule("no_leaks", ~F.col("leaks")),
        Rule("places_agree", F.col("displaced") == "", "warning", 2, least_rate=0.9), Rule("names_mapped", F.col("unmapped") == "", "important", 2, least_rate=0.95),
    ]
    return quality.pass_rates(rows, rules).withColumn("pass_rate", F.round("pass_rate", 6))


def dq_answer_fit(spark, sf_dir):
    """Answers against the chain's final answer, the subtype's polarity and the wording of directions, by relation."""
    c = F.col
    rows = frame(spark, sf_dir, "records").withColumns({"final": F.expr(_FINAL), "label": record.topology_label(c("subtype")), "kind": F.coalesce("relation", F.lit("none"))})
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(~chain.same_answer(c("answer"), c("final"))).alias("unlike_final"),
        F.count_if((c("relation") == "topological") & ~chain.polarity_fits(c("label"), c("answer"))).alias("wrong_polarity"),
        F.count_if(~chain.direction_worded(F.concat_ws(" ", "question", "answer", F.expr(_WORDED)))).alias("odd_wording"),
    )


_FINAL = f"concat({pick('id', ['相邻', '不相邻。', '包含，约', ' 重叠', ''])}, {pick('length', ['', '！'])})"
_WORDED = pick("length", ["正东", "北偏东", "", "甲地"])


def dq_difficulty(spark, sf_dir):
    """Scores against the theoretical score, and levels against half-open score bands, by relation."""
    c, types = F.col, F.transform(F.array("type1", "type2"), record.entity_type)
    rows = frame(spark, sf_dir, "records").withColumns({"kind": F.coalesce("relation", F.lit("none")), "off": F.abs(c("score") - record.difficulty_score(c("relation"), record.topology_label(c("subtype")), types))})
    band = F.when(c("score") <= 2.0, "easy").when(c("score") <= 3.5, "medium").otherwise("hard")
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(c("off") > 0.5 + 1e-9).alias("deviant"), F.round(F.avg("off"), 6).alias("mean_off"), F.round(F.max("off"), 6).alias("most_off"), F.count_if(band != c("difficulty")).alias("misplaced")
    )


#: Names to be covered; those beyond the numbers of the records are named by none.
_NAMES = [f"城市{k}" for k in range(0, 96, 3)] + ["无名城", "远方城"]


def dq_coverage(spark, sf_dir):
    """Every one of 34 listed names with the number of questions that name it (longest names first, so that 城市1 is not found in 城市12), and
    whether at least 30 of the names occur."""
    listed = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    table = {n: n for n in [f"城市{k}" for k in range(100)] + _NAMES}
    found = frame(spark, sf_dir, "records").select(F.explode(F.array_distinct(F.transform(names.spans(F.col("question"), table), lambda s: s["name"]))).alias("name"))
    n = listed.join(found.groupBy("name").agg(F.count("*").alias("n")), "name", "left").na.fill(0, ["n"])
    return n.crossJoin(n.agg((F.count_if(F.col("n") > 0) >= 30).alias("enough")))


#: What curated entities state and what is known of them, as SQL of both engines; items are joined by commas.
_CURATED = {
    "entity": "concat('地', c_custkey, " + pick("c_custkey", ["市", "省", ""]) + ")", "kind": pick("c_custkey", ["position", "origin", "peak", "provinces", "neighbours"]),
    "lon": "CASE WHEN c_custkey % 41 > 0 THEN 70 + CAST(c_custkey * 37 % 700 AS DOUBLE) / 10 END", "lat": "15 + CAST(c_custkey * 53 % 420 AS DOUBLE) / 10",
    "text": pick("c_custkey * 3", ["青海 唐古拉山", "巴颜喀拉山", "", "秦岭", "唐古拉", "太白山", None]), "items": "concat_ws(',', " + ", ".join(f"CASE WHEN c_custkey % {m} > 0 THEN '{x}' END" for m, x in ((2, "甲"), (3, "乙"), (4, "丙"))) + ")",
}
_KNOWN = {
    "entity": "concat('地', c_custkey)", "kind": _CURATED["kind"], "lon": f"{_CURATED['lon']} + CAST(c_custkey % 13 AS DOUBLE) / 4 - 1", "lat": f"{_CURATED['lat']} + CAST(c_custkey % 11 AS DOUBLE) / 8",
    "text": pick("c_custkey * 5 + 1", ["唐古拉山 各拉丹冬", "青海 唐古拉山", "秦岭", "太白山", "巴颜喀拉山"]), "items": "concat_ws(',', '甲', " + ", ".join(f"CASE WHEN c_custkey % {m} > 0 THEN '{x}' END" for m, x in ((5, "乙"), (7, "丁"))) + ")",
}


def dq_known_facts(spark, sf_dir):
    """Positions, origins, peaks and lists of curated entities held against known facts of three quarters of them."""
    c = frame(spark, sf_dir, "customer")
    listed = lambda df: df.withColumn("items", F.filter(F.split("items", ","), lambda x: x != ""))
    stated, known = (listed(c.selectExpr("c_custkey AS k", *[f"{e} AS {n}" for n, e in x.items()])) for x in (_CURATED, _KNOWN))
    return facts.fact_issues(stated.drop("k"), known.where("k % 4 > 0").drop("k"))


def dq_one_sided(spark, sf_dir):
    """Neighbours that are listed on one side only."""
    e = frame(spark, sf_dir, "nation").selectExpr("n_nationkey AS entity", "transform(sequence(1, 6), i -> (n_nationkey * i + i * i) % 30) AS items")
    return facts.one_sided(e.withColumn("items", F.expr("transform(items, i -> CAST(i AS INT))")).withColumn("entity", F.col("entity").cast("int")))


def str_name_spans(spark, sf_dir):
    """Every name in every question, as spans in code points, with how many of a record's own names were found."""
    r = frame(spark, sf_dir, "records").select("id", "question", "name1", "name2")
    table = names.table_of(r.select(F.explode(F.array("name1", "name2")).alias("name")))
    found = r.select("id", names.spans(F.col("question"), table).alias("spans"), F.array_compact(F.array("name1", "name2")).alias("own"))
    text = F.transform("spans", lambda s: F.format_string("%s@%d-%d", s["name"], s["char_start"], s["char_end"]))
    have = F.size(F.array_intersect(F.transform("spans", lambda s: s["name"]), "own"))
    return found.select("id", F.array_join(text, ",").alias("spans"), have.alias("own_found"), F.size(F.array_distinct("own")).alias("own"))


def join_name_lookup(spark, sf_dir):
    """Names as written, looked up by name, alias or suffix among the entities of the same group."""
    known = frame(spark, sf_dir, "nation").selectExpr("n_regionkey AS g", "concat('地', n_nationkey, '市') AS name")
    known = known.union(frame(spark, sf_dir, "nation").selectExpr("n_regionkey", "concat('地', n_nationkey)").where("n_nationkey % 6 = 0"))
    asked = frame(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_nationkey % 5 AS g", "concat('地', c_custkey % 25, " + pick("c_custkey", ["市", "县", "", "特别行政区"]) + ") AS asked")
    asked = asked.withColumn("asked", F.when(F.col("id") % 13 == 0, "首府").otherwise(F.col("asked")))
    return names.lookup(asked, "asked", known, group="g", aliases={"地3市": ["首府"], "地4市": ["首府", "旧都"]}).select("id", "found", "how")


_FACTS = ["direction_8", "direction_8_en", "azimuth_deg", "distance_km", "within", "contains", "touches", "crosses", "disjoint"]
_REL = "replace(relation, 'direction', 'directional')"
_STATED = "(km + a * {k} + b) % 6 > 0"
_VALUE = "CASE WHEN (km + b + {k}) % 10 > 0 THEN 'false' ELSE 'true' END"


def _pairs(spark, sf_dir):
    facts = F.map_from_entries(F.array_compact(F.array(*[F.expr(f"CASE WHEN {_STATED.format(k=k + 2)} THEN struct('{f}' AS k, {_VALUE.format(k=k)} AS v) END") for k, f in enumerate(_FACTS)])))
    return frame(spark, sf_dir, "pairs").withColumns({"rel": F.expr(_REL), "facts": facts, "reference": F.expr("CASE WHEN a % 8 = 0 THEN NULL WHEN a % 8 = 1 THEN '' ELSE 'r' END")})


def dq_pair_facts(spark, sf_dir):
    """Required facts that pairs do not state, by relation and fact."""
    p = _pairs(spark, sf_dir).select("rel", F.explode(pair.missing_facts(F.col("rel"), F.col("facts"))).alias("fact"))
    return p.groupBy("rel", "fact").agg(F.count("*").alias("n"))


def dq_pair_layer(spark, sf_dir):
    """References, negative examples and stated fields, by relation."""
    c = F.col
    fields = pair.stated_fields(F.expr("CASE WHEN a % 3 > 0 THEN 1 END"), F.expr("CASE WHEN b % 4 > 0 THEN 1 END"), F.expr("CASE WHEN km % 5 > 0 THEN 1 END"))
    p = _pairs(spark, sf_dir).withColumns({"fields": fields, "affirmed": F.size(pair.affirmed_facts(c("facts")))})
    return p.groupBy("rel", F.coalesce(F.when(c("negative"), c("fields")), F.lit("-")).alias("fields")).agg(
        F.count("*").alias("n"), F.count_if(~pair.reference_fits(c("rel"), c("reference"))).alias("no_reference"), F.sum(F.when(c("negative"), c("affirmed")).otherwise(0)).cast("long").alias("affirmed")
    )


def dq_pair_outliers(spark, sf_dir):
    """Entities with positions outside a box, on either side of their pairs, in one pass."""
    side = lambda x: F.struct(F.lit(x).alias("side"), F.col(x).alias("entity"), F.col(f"{x}_lon").alias("lon"), F.col(f"{x}_lat").alias("lat"), F.expr(f"nullif({x}_type, 'lake')").alias("type"))
    sides = frame(spark, sf_dir, "pairs").select(F.explode(F.array(side("a"), side("b"))).alias("s")).select("s.*")
    out = ~(F.col("lon").between(75, 130) & F.col("lat").between(20, 50))
    return sides.groupBy("side", "entity").agg(F.count_if(out).alias("outside"), F.count_if(F.col("type").isNull()).alias("untyped"), F.count("*").alias("n")).where("outside > 0 OR untyped > 0")


def join_error_samples(spark, sf_dir):
    """Wrong predictions joined to their records, with records that are missing."""
    a = frame(spark, sf_dir, "answers").where("prediction <> reference").select("id", "spatial_type", "prediction")
    r = frame(spark, sf_dir, "records").where("id % 10 > 0").select("id", "question")
    return a.join(r, "id", "left").groupBy("spatial_type", F.col("question").isNull().alias("lost")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def join_pair_entities(spark, sf_dir):
    """Pairs with both their entities, by types of the two."""
    e = frame(spark, sf_dir, "entities").select("entity_id", "name", "type")
    one, two = e.selectExpr("entity_id AS a", "type AS one"), e.selectExpr("entity_id AS b", "type AS two")
    return frame(spark, sf_dir, "pairs").join(one, "a").join(two, "b").groupBy("one", "two").agg(F.count("*").alias("n"), F.count_if("negative").alias("negatives"))


def agg_merge_counters(spark, sf_dir):
    """Counters of several files merged by key: partial counts, then their sum."""
    parts = frame(spark, sf_dir, "answers").groupBy((F.col("id") % 4).alias("file"), "spatial_type").agg(F.count("*").alias("n"))
    more = frame(spark, sf_dir, "records").groupBy((F.col("id") % 3).alias("file"), F.coalesce("relation", F.lit("none")).alias("spatial_type")).agg(F.count("*").alias("n"))
    return parts.unionByName(more).groupBy("spatial_type").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max("n").alias("most"))


def spl_fixed(spark, sf_dir):
    return sampling.fixed_split(frame(spark, sf_dir, "answers").select("id", "spatial_type", "difficulty"), ["spatial_type", "difficulty"], (8000, 800, 3000))


def sam_by_level(spark, sf_dir):
    return sampling.by_level(frame(spark, sf_dir, "answers").select("id", "difficulty"), "difficulty", 55, {"easy": 0.3, "medium": 0.5, "hard": 0.2})


def sam_levels(spark, sf_dir):
    """Levels by rank within each type, with scores drawn from the level's range."""
    bands = [(0.3, "easy", 1.0, 2.0), (0.5, "medium", 2.0, 3.5), (0.2, "hard", 3.5, 5.0)]
    return sampling.levels_by_rank(frame(spark, sf_dir, "answers").select("id", "spatial_type"), ["spatial_type"], bands)


def prj_known_names(spark, sf_dir):
    """List attributes restricted to known names."""
    n = frame(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("E"), (F.col("n_nationkey") * 17 + i).cast("string")))).alias("pos", "name"))
    known = frame(spark, sf_dir, "entities").select("name").distinct()
    kept = n.join(known, "name", "left_semi").groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("k"))
    return kept.select("n_nationkey", F.array_join(F.transform("k", lambda x: x["name"]), ",").alias("names"))


QUERIES = {
    f.__name__: f
    for f in (
        dq_chains, dq_chain_rates, dq_answer_fit, dq_difficulty, dq_coverage, dq_known_facts, dq_one_sided, str_name_spans, join_name_lookup, dq_pair_facts, dq_pair_layer, dq_pair_outliers, join_error_samples, join_pair_entities, agg_merge_counters,
        spl_fixed, sam_by_level, sam_levels, prj_known_names,
    )
}

_GAP = "CASE WHEN NOT (h_name AND h_action AND h_content) THEN concat(step, ':', concat_ws(',', CASE WHEN NOT h_name THEN 'name' END, CASE WHEN NOT h_action THEN 'action' END, CASE WHEN NOT h_content THEN 'content' END)) WHEN step <= 5 AND NOT (h_own AND @ = step) THEN concat(step, ':', CASE step WHEN 1 THEN 'entities_involved' WHEN 2 THEN 'relation_type' WHEN 3 THEN 'coordinates' WHEN 4 THEN 'calculation_result' ELSE 'final_answer' END) END"
_CHAINS = f"""steps AS (SELECT * FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in _STEPS.items())} FROM lineitem) QUALIFY row_number() OVER (PARTITION BY id, step ORDER BY {', '.join(list(_STEPS)[2:])}) = 1),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step) AS k FROM steps),
 said AS (SELECT id, place, min_by(lon, step) AS lon, min_by(lat, step) AS lat FROM steps GROUP BY ALL), known AS (SELECT id, place, min_by(known_lon, step) AS lon, min_by(known_lat, step) AS lat FROM steps WHERE known GROUP BY ALL),
 off AS (SELECT id, string_agg(place, ',' ORDER BY place) AS displaced FROM said JOIN known k USING (id, place) WHERE abs(said.lon - k.lon) >= 0.01 OR abs(said.lat - k.lat) >= 0.01 GROUP BY id),
 bare AS (SELECT id, string_agg(place, ',' ORDER BY place) AS unmapped FROM (SELECT DISTINCT id, place FROM steps WHERE NOT mapped) GROUP BY id),
 chains AS (SELECT id, count(*) AS steps, count(*) = 5 AS five, min({_GAP.replace('step', 'k').replace('@', 'step')}) AS first_gap, bool_or(h_own AND step IN (2, 4)) AS leaks, count(*) = 5 AND bool_and(h_name AND h_action AND h_content) AS whole,
  coalesce(any_value(displaced), '') AS displaced, coalesce(any_value(unmapped), '') AS unmapped FROM numbered LEFT JOIN off USING (id) LEFT JOIN bare USING (id) GROUP BY id)"""
_RATES = [("chain_length", "five", 0.95), ("chain_fields", "first_gap IS NULL", 0.95), ("no_leaks", "NOT leaks", 1.0), ("places_agree", "displaced = ''", 0.9), ("names_mapped", "unmapped = ''", 0.95)]
_BARE = "regexp_replace({}, '[，。！？、\\s]', '', 'g')"
_HAS = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_YES, _NO = _HAS("answer", V.AFFIRMING), _HAS("answer", V.DENYING)
_TEXT = f"concat_ws(' ', question, answer, {_WORDED})"
_LABEL = "CASE lower(trim(subtype)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TOPOLOGY_LABELS.items()) + " ELSE lower(trim(subtype)) END"
_LOOK = lambda c, t, other: f"coalesce(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + f" END, {other})"
_TYPED = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ENTITY_TYPES.items()) + f" ELSE {c} END"
_BONUS = _LOOK(f"concat(least({_TYPED('type1')}, {_TYPED('type2')}), '|', greatest({_TYPED('type1')}, {_TYPED('type2')}))", {"|".join(sorted(k)): v for k, v in V.PAIR_BONUS.items()}, 0.5)
_THEORY = f"least(greatest(({_LOOK('relation', {'directional': 1.2, 'topological': 2.2, 'metric': 1.3, 'composite': 3.2}, 2.0)} + {_LOOK(_LABEL, V.TOPOLOGY_BONUS, 0.0)} + {_BONUS})::DOUBLE, 1.0), 5.0)"
_NEEDED = {
    "direction_8": "contains(rel, 'directional')", "direction_8_en": "contains(rel, 'directional')", "azimuth_deg": "contains(rel, 'directional')", "distance_km": "contains(rel, 'metric') OR contains(rel, 'distance')",
    "within": "contains(rel, 'within')", "contains": "contains(rel, 'contains')", "touches": "contains(rel, 'touches')", "crosses": "contains(rel, 'crosses')", "disjoint": "contains(rel, 'disjoint')",
}
_FIELDS = "CASE (a % 3 > 0)::INT + (b % 4 > 0)::INT + (km % 5 > 0)::INT WHEN 3 THEN 'direction+distance+within' WHEN 2 THEN CASE WHEN km % 5 = 0 THEN 'direction+distance' WHEN b % 4 = 0 THEN 'direction+within' ELSE 'distance+within' END END"
_AFFIRMED = " + ".join(f"(({_STATED.format(k=k + 2)}) AND (km + b + {k}) % 10 = 0)::INT" for k in range(len(_FACTS)))
_GROUP = "row_number() OVER (PARTITION BY {} ORDER BY md5(concat(id, '|42')), id)"
ORACLES = {
    "dq_chains": f"WITH {_CHAINS} SELECT * FROM chains",
    "dq_chain_rates": f"WITH {_CHAINS}, u AS ({' UNION ALL '.join(f'''SELECT '{n}' AS check_name, count(*) AS total, count(*) FILTER (WHERE NOT ({ok})) AS failed, {r} AS least FROM chains''' for n, ok, r in _RATES)}) SELECT check_name, total, failed, round(1 - failed / total, 6) AS pass_rate, 1 - failed / total >= least AS passed FROM u",
    "dq_answer_fit": sql(f"""WITH x AS (SELECT *, {_BARE.format('answer')} AS x, {_BARE.format(_FINAL)} AS y, {_LABEL} AS label, {_TEXT} AS worded FROM records)
        SELECT coalesce(relation, 'none') AS kind, count(*) AS n, count(*) FILTER (WHERE NOT (contains(x, y) OR contains(y, x))) AS unlike_final,
        count(*) FILTER (WHERE relation = 'topological' AND ((label = 'disjoint' AND {_YES} AND NOT contains(answer, '不') AND NOT {_NO}) OR (label IN ('within', 'contains', 'adjacent', 'overlap') AND {_NO} AND NOT {_YES}))) AS wrong_polarity,
        count(*) FILTER (WHERE regexp_matches(worded, '北偏东|东偏北|南偏东|东偏南|南偏西|西偏南|北偏西|西偏北|正北|正东|正南|正西') AND NOT regexp_matches(regexp_replace(worded, '北偏东|东偏北|南偏东|东偏南|南偏西|西偏南|北偏西|西偏北|正北|正东|正南|正西', '', 'g'), '[东南西北]')) AS odd_wording FROM x GROUP BY 1""", "records"),
    "dq_difficulty": sql(f"""WITH x AS (SELECT *, abs(score - {_THEORY}) AS off FROM records) SELECT coalesce(relation, 'none') AS kind, count(*) AS n, count(*) FILTER (WHERE off > 0.5 + 1e-9) AS deviant, round(avg(off), 6) AS mean_off, round(max(off), 6) AS most_off,
        count(*) FILTER (WHERE CASE WHEN score <= 2.0 THEN 'easy' WHEN score <= 3.5 THEN 'medium' ELSE 'hard' END <> difficulty) AS misplaced FROM x GROUP BY 1""", "records"),
    "dq_coverage": sql(f"""WITH l AS (SELECT unnest({_NAMES}) AS name), f AS (SELECT DISTINCT id, unnest(regexp_extract_all(question, '城市[0-9]+')) AS name FROM records),
        c AS (SELECT l.name, count(f.id) AS n FROM l LEFT JOIN f USING (name) GROUP BY l.name) SELECT *, (SELECT count(*) FILTER (WHERE n > 0) >= 30 FROM c) AS enough FROM c""", "records"),
    "dq_known_facts": f"""WITH a AS (SELECT c_custkey AS k, {', '.join(f'{e} AS {n}' for n, e in _CURATED.items())} FROM customer), f AS (SELECT c_custkey AS k, {', '.join(f'{e} AS f_{n}' for n, e in _KNOWN.items())} FROM customer WHERE c_custkey % 4 > 0),
        b AS (SELECT *, list_filter(string_split(items, ','), lambda x: x <> '') AS have, list_filter(string_split(f_items, ','), lambda x: x <> '') AS want, lon BETWEEN 73 AND 135 AND lat BETWEEN 18 AND 54 AS inside, string_split(f_text, ' ')[1:2] AS words,
          pow(sin(radians(f_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(f_lat)) * pow(sin(radians(f_lon - lon) / 2), 2) AS h FROM a LEFT JOIN f USING (k)),
        d AS (SELECT *, 12742 * atan2(sqrt(h), sqrt(1 - h)) AS km, CASE kind WHEN 'position' THEN lon IS NOT NULL WHEN 'provinces' THEN len(have) > 0 WHEN 'neighbours' THEN len(have) > 0 ELSE coalesce(text <> '', false) END AS full_, list_sort(list_filter(want, lambda x: NOT list_contains(have, x))) AS miss, list_sort(list_filter(have, lambda x: NOT list_contains(want, x))) AS more FROM b)
        SELECT entity, kind, 'empty' AS issue, '' AS detail, 'warning' AS severity FROM d WHERE NOT full_
        UNION ALL SELECT entity, kind, 'outside', printf('%.3f,%.3f', lon, lat), 'critical' FROM d WHERE kind = 'position' AND full_ AND NOT inside
        UNION ALL SELECT entity, kind, 'displaced', printf('%.0f', floor(km)), CASE WHEN km > 200 THEN 'critical' WHEN km > 100 THEN 'error' ELSE 'warning' END FROM d WHERE kind = 'position' AND full_ AND inside AND (abs(lon - f_lon) > 0.5 OR abs(lat - f_lat) > 0.5)
        UNION ALL SELECT entity, kind, 'different', concat(text, ' / ', f_text), 'error' FROM d WHERE full_ AND f_text IS NOT NULL AND ((kind = 'peak' AND text <> f_text) OR (kind = 'origin' AND NOT (contains(text, f_text) OR contains(f_text, text) OR len(list_filter(words, lambda w: contains(text, w))) > 0)))
        UNION ALL SELECT entity, kind, 'missing', array_to_string(miss, ','), 'error' FROM d WHERE full_ AND kind IN ('provinces', 'neighbours') AND len(miss) > 0
        UNION ALL SELECT entity, kind, 'extra', array_to_string(more, ','), 'error' FROM d WHERE full_ AND kind = 'provinces' AND f_items IS NOT NULL AND len(more) > 0""",
    "dq_one_sided": """WITH e AS (SELECT n_nationkey::INT AS entity, unnest([1, 2, 3, 4, 5, 6]) AS i FROM nation), l AS (SELECT DISTINCT entity, ((entity * i + i * i) % 30)::INT AS item FROM e)
        SELECT entity, item FROM l WHERE item IN (SELECT n_nationkey FROM nation) AND (item, entity) NOT IN (SELECT (entity, item) FROM l)""",
    "str_name_spans": sql("""WITH e AS (SELECT id, name1, name2, question, regexp_extract_all(question, '城市[0-9]+') AS m FROM records), known AS (SELECT name1 AS n FROM records UNION SELECT name2 FROM records),
        p AS (SELECT *, strpos(question, m[1]) - 1 AS s1, length(question) - length(regexp_replace(question, '^.*?城市[0-9]+与', '')) AS s2 FROM e)
        SELECT id, concat_ws(',', CASE WHEN m[1] IN (SELECT n FROM known) THEN concat(m[1], '@', s1, '-', s1 + length(m[1])) END, CASE WHEN m[2] IN (SELECT n FROM known) THEN concat(m[2], '@', s2, '-', s2 + length(m[2])) END) AS spans,
        ((name1 IN (m[1], m[2]))::INT + (name2 IS NOT NULL AND name2 <> name1 AND name2 IN (m[1], m[2]))::INT) AS own_found, CASE WHEN name2 IS NULL OR name2 = name1 THEN 1 ELSE 2 END AS own FROM p""", "records"),
    "join_name_lookup": f"""WITH base AS (SELECT n_regionkey AS g, concat('地', n_nationkey, '市') AS name FROM nation UNION SELECT n_regionkey, concat('地', n_nationkey) FROM nation WHERE n_nationkey % 6 = 0),
        k AS (SELECT g, name, 0 AS rank, name AS v FROM base UNION ALL SELECT g, name, 1, '首府' FROM base WHERE name IN ('地3市', '地4市') UNION ALL SELECT g, name, 2, '旧都' FROM base WHERE name = '地4市' UNION ALL SELECT g, name, 3, replace(name, '市', '') FROM base WHERE name LIKE '%市'),
        a AS (SELECT c_custkey AS id, c_nationkey % 5 AS g, CASE WHEN c_custkey % 13 = 0 THEN '首府' ELSE concat('地', c_custkey % 25, {pick('c_custkey', ['市', '县', '', '特别行政区'])}) END AS asked FROM customer),
        t AS (SELECT *, 0 AS cut, asked AS v FROM a UNION ALL SELECT *, 1, regexp_replace(asked, '(特别行政区|市|县)$', '') FROM a WHERE regexp_matches(asked, '(特别行政区|市|县)$')),
        h AS (SELECT t.id, arg_min(k.name, (t.cut, k.rank, k.name)) AS found, arg_min(t.asked, (t.cut, k.rank, k.name)) AS asked FROM t JOIN k USING (g, v) GROUP BY t.id)
        SELECT a.id, found, CASE WHEN found = a.asked THEN 'name' WHEN a.asked IN ('首府', '旧都') AND found IS NOT NULL THEN 'alias' WHEN found IS NOT NULL THEN 'suffix' END AS how FROM a LEFT JOIN h USING (id)""",
    "dq_pair_facts": sql("WITH p AS (SELECT *, " + _REL + " AS rel FROM pairs) " + " UNION ALL ".join(f"SELECT rel, '{f}' AS fact, count(*) AS n FROM p WHERE ({_NEEDED[f]}) AND NOT ({_STATED.format(k=k + 2)}) GROUP BY rel" for k, f in enumerate(_FACTS)), "pairs"),
    "dq_pair_layer": sql(f"""SELECT {_REL} AS rel, coalesce(CASE WHEN negative THEN {_FIELDS} END, '-') AS fields, count(*) AS n, count(*) FILTER (WHERE a % 8 < 2 AND NOT regexp_matches(relation, 'metric|touches|disjoint')) AS no_reference,
        sum(CASE WHEN negative THEN {_AFFIRMED} ELSE 0 END)::BIGINT AS affirmed FROM pairs GROUP BY ALL""", "pairs"),
    "dq_pair_outliers": sql("""WITH s AS (SELECT 'a' AS side, a AS entity, a_lon AS lon, a_lat AS lat, a_type AS type FROM pairs UNION ALL SELECT 'b', b, b_lon, b_lat, b_type FROM pairs)
        SELECT * FROM (SELECT side, entity, count(*) FILTER (WHERE lon < 75 OR lon > 130 OR lat < 20 OR lat > 50) AS outside, count(*) FILTER (WHERE type = 'lake') AS untyped, count(*) AS n FROM s GROUP BY ALL) WHERE outside > 0 OR untyped > 0""", "pairs"),
    "join_error_samples": sql("SELECT spatial_type, id % 10 = 0 AS lost, count(*) AS n, sum(id)::BIGINT AS ids FROM answers WHERE prediction <> reference GROUP BY ALL", "answers"),
    "join_pair_entities": sql("SELECT x.type AS one, y.type AS two, count(*) AS n, count(*) FILTER (WHERE negative) AS negatives FROM pairs JOIN entities x ON x.entity_id = a JOIN entities y ON y.entity_id = b GROUP BY ALL", "pairs", "entities"),
    "agg_merge_counters": sql("WITH p AS (SELECT id % 4 AS file, spatial_type, count(*) AS n FROM answers GROUP BY ALL UNION ALL SELECT id % 3, coalesce(relation, 'none'), count(*) FROM records GROUP BY ALL) SELECT spatial_type, sum(n)::BIGINT AS n, count(*) AS parts, max(n) AS most FROM p GROUP BY 1", "answers", "records"),
    "spl_fixed": sql(f"""WITH r AS (SELECT id, spatial_type, difficulty, {_GROUP.format('spatial_type, difficulty')} AS r, count(*) OVER (PARTITION BY spatial_type, difficulty) AS n FROM answers),
        q AS (SELECT *, greatest(1, floor(n * (8000 / 11800) + 1e-9)) AS a, greatest(1, floor(n * (800 / 11800) + 1e-9)) AS b, greatest(1, floor(n * (3000 / 11800) + 1e-9)) AS c FROM r),
        w AS (SELECT *, CASE WHEN a + b + c > n THEN greatest(1, floor(a * n / (a + b + c) + 1e-9)) ELSE a END AS x, CASE WHEN a + b + c > n THEN greatest(1, floor(b * n / (a + b + c) + 1e-9)) ELSE b END AS y FROM q)
        SELECT id, spatial_type, difficulty, CASE WHEN r <= x THEN 'train' WHEN r <= x + y THEN 'dev' WHEN r <= x + y + CASE WHEN a + b + c > n THEN n - x - y ELSE c END THEN 'test' END AS split FROM w""", "answers"),
    "sam_by_level": sql(f"WITH r AS (SELECT id, difficulty, {_GROUP.format('difficulty')} AS rank FROM answers) SELECT * FROM r WHERE rank <= CASE difficulty WHEN 'easy' THEN 16 WHEN 'medium' THEN 27 WHEN 'hard' THEN 12 ELSE 0 END", "answers"),
    "sam_levels": sql(f"""WITH r AS (SELECT id, spatial_type, {_GROUP.format('spatial_type')} AS r, count(*) OVER (PARTITION BY spatial_type) AS n, ('0x' || substr(md5(concat(id, '|42 score')), 1, 8))::BIGINT / 4294967296.0 AS u FROM answers),
        l AS (SELECT *, CASE WHEN r <= floor(n * 0.3 + 1e-9) THEN 'easy' WHEN r <= floor(n * 0.3 + 1e-9) + floor(n * 0.5 + 1e-9) THEN 'medium' ELSE 'hard' END AS level FROM r)
        SELECT id, spatial_type, level, round(CASE level WHEN 'easy' THEN 1 + u WHEN 'medium' THEN 2 + 1.5 * u ELSE 3.5 + 1.5 * u END, 1) AS score FROM l""", "answers"),
    "prj_known_names": sql("SELECT n_nationkey, string_agg(name, ',' ORDER BY i) AS names FROM (SELECT n_nationkey, i, concat('E', n_nationkey * 17 + i) AS name FROM (SELECT n_nationkey, unnest(range(1, 41)) AS i FROM nation)) WHERE name IN (SELECT name FROM entities) GROUP BY n_nationkey", "entities"),
}
