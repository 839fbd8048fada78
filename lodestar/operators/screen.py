"""Whole records, as lines of JSON, screened against every rule in one pass; acceptance of a finished dataset."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import vocabulary as V
from lodestar.functions.let import let

# fixed values: the fields of a record that are always there, the kinds of entity, the steps of a chain with their actions, internal fields, contradictory words
FIELDS = ["id", "spatial_relation_type", "question", "answer", "difficulty", "difficulty_score", "reasoning_chain", "entities", "spatial_tokens", "entity_to_token"]
ENTITY_KINDS = ["province", "city", "landmark", "river", "mountain", "lake", "region"]
STEP_NAMES = ["entity_identification", "spatial_relation_extraction", "coordinate_retrieval", "spatial_calculation", "answer_generation"]
INTERNAL_FIELDS = ["_validation_errors", "_fixed", "_issues", "_errors"]
OPPOSITES = [("是", "否"), ("存在", "不存在"), ("包含", "不包含"), ("位于", "不位于"), ("相邻", "不相邻"), ("在", "不在"), ("yes", "no"), ("true", "false")]
MAPPING_KEYS = ["char_start", "char_end", "token_indices"]
_OBJECTS = "array<map<string,variant>>"


def _text(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def _found(when: Column, check: str, detail: Column | str = "") -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), (F.lit(detail) if isinstance(detail, str) else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail")))


def _each(items: Column, check: str, when, detail) -> Column:
    """A finding for every item for which `when` holds."""
    return F.transform(F.filter(items, lambda x: F.coalesce(when(x), F.lit(False))), lambda x: F.struct(F.lit(check).alias("check"), F.coalesce(detail(x).cast("string"), F.lit("")).alias("detail")))


def _opposed(one: Column, two: Column) -> Column:
    """Whether one text has a word and the other its opposite, of which it may be a part: 不包含 twice is no contradiction."""
    out = F.lit(False)
    for yes, no in OPPOSITES:
        bare = [F.contains(F.replace(t, F.lit(no), F.lit("")), F.lit(yes)) for t in (one, two)]
        says_no = [F.contains(t, F.lit(no)) for t in (one, two)]
        out = out | (bare[0] & says_no[1] & ~says_no[0]) | (bare[1] & says_no[0] & ~says_no[1])
    return out


def anomalies(lines: DataFrame, text: str = "text", box: tuple[float, float, float, float] = V.CHINA_BOX) -> DataFrame:
    """(record_id, relation, check, detail) of every finding, from lines that are JSON objects (others have no finding here: see ``ingest``).

    Fields, values and kinds; lengths of question and answer; the chain's length, fields, numbers and names of steps, entities that the record does not
    have, leaked fields; entities, their kinds and positions; the token map; the answer against the chain's. Findings in lists come once for each item. Rules about a field that is
    missing or of another type give nothing but that.
    """
    v = F.col("v")
    get = lambda field, kind: F.try_variant_get(v, f"$.{field}", kind)
    rows = lines.select(F.try_parse_json(f"`{text}`").alias("v"), F.col(f"`{text}`").alias("raw")).where(F.schema_of_variant("v").startswith("OBJECT"))
    rows = rows.select(
        get("id", "string").alias("record_id"), get("spatial_relation_type", "string").alias("relation"), get("topology_subtype", "string").alias("subtype"), get("question", "string").alias("question"), get("answer", "string").alias("answer"),
        get("difficulty", "string").alias("difficulty"), get("difficulty_score", "double").alias("score"), get("reasoning_chain", _OBJECTS).alias("chain"), get("entities", _OBJECTS).alias("entities"),
        get("spatial_tokens", "array<string>").alias("tokens"), get("entity_to_token", "map<string,variant>").alias("mapping"), F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")).alias("keys"),
    )
    c = F.col
    has = lambda f: F.array_contains("keys", f)
    topological, chain, entities = c("relation") == "topological", F.coalesce(c("chain"), F.array().cast(_OBJECTS)), F.coalesce(c("entities"), F.array().cast(_OBJECTS))
    names = F.array_compact(F.transform(entities, lambda e: _text(F.try_element_at(e, F.lit("name")))))
    length = lambda f, lo, hi: ~F.char_length(f).between(lo, hi)
    at = lambda m, key: F.try_element_at(m, F.lit(key))
    step = lambda s: _text(at(s, "step"))
    place = lambda e: F.try_variant_get(at(e, "coords"), "$", "array<double>")
    flat = F.array(
        *[_found(~has(f), "missing_field", f) for f in FIELDS],
        _found(~c("relation").isin(V.RELATIONS), "unknown_relation", c("relation")), _found(topological & F.coalesce(c("subtype") == "", F.lit(True)), "missing_subtype"),
        _found(topological & (c("subtype") != "") & ~c("subtype").isin(V.TOPOLOGY), "unknown_subtype", c("subtype")), _found(~c("difficulty").isin("easy", "medium", "hard"), "unknown_difficulty", c("difficulty")),
        _found(has("difficulty_score") & ~F.coalesce(c("score").between(1.0, 5.0), F.lit(False)), "score_out_of_range", c("score")), _found(length("question", 10, 200), "question_length", F.char_length("question")),
        _found(length("answer", 2, 100), "answer_length", F.char_length("answer")), _found(has("reasoning_chain") & (F.size(chain) != 5), "chain_length", F.size(chain)),
        _found(has("entities") & (F.size(entities) < 2), "few_entities", F.size(entities)), _found(has("spatial_tokens") & F.coalesce(F.size("tokens") == 0, F.lit(True)), "no_tokens"),
        _found((F.size("tokens") > 0) & ~F.size("tokens").between(4, 8), "token_count", F.size("tokens")), _found(_opposed(F.lower("answer"), F.lower(_text(at(F.try_element_at(chain, F.lit(-1)), "final_answer")))), "answer_contradicts"),
    )
    numbered = F.transform(chain, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    lists = [
        _each(F.flatten(F.transform(chain, lambda s: F.transform(F.filter(F.array(*map(F.lit, V.STEP_FIELDS)), lambda f: ~F.map_contains_key(s, f)), lambda f: F.concat_ws(":", step(s), f)))), "step_field", lambda x: F.lit(True), lambda x: x),
        _each(F.filter(numbered, lambda x: F.lit(True)), "step_number", lambda x: (F.size(chain) == 5) & (F.coalesce(step(x["s"]), F.lit("")) != (x["i"] + 1).cast("string")), lambda x: x["i"] + 1),
        _each(chain, "step_name", lambda s: ~_text(at(s, "name")).isin(STEP_NAMES), lambda s: _text(at(s, "name"))),
        _each(numbered, "step_order", lambda x: (F.size(chain) == 5) & _text(at(x["s"], "name")).isin(STEP_NAMES) & (_text(at(x["s"], "name")) != F.try_element_at(F.array(*map(F.lit, STEP_NAMES)), (x["i"] + 1).cast("int"))), lambda x: x["i"] + 1),
        _each(F.flatten(F.transform(chain, lambda s: F.coalesce(F.try_variant_get(at(s, "entities_involved"), "$", "array<string>"), F.array().cast("array<string>")))), "entity_unknown", lambda n: ~F.array_contains(names, n), lambda n: n),
        *[_each(chain, f"leaked_{f}", lambda s, f=f: F.map_contains_key(s, F.lit(f)), step) for f in ("relation_type", "calculation_result")],
        _each(entities, "entity_without_name", lambda e: ~F.map_contains_key(e, F.lit("name")), lambda e: F.lit("")),
        _each(entities, "entity_kind", lambda e: ~_text(at(e, "type")).isin(ENTITY_KINDS), lambda e: _text(at(e, "type"))),
        _each(entities, "entity_without_place", lambda e: ~F.map_contains_key(e, F.lit("coords")), lambda e: _text(at(e, "name"))),
        _each(entities, "place_format", lambda e: F.map_contains_key(e, F.lit("coords")) & F.coalesce(F.size(place(e)) != 2, F.lit(True)), lambda e: _text(at(e, "name"))),
        _each(entities, "place_outside", lambda e: let(place(e), lambda p: (F.size(p) == 2) & ~(F.get(p, 0).between(box[0], box[1]) & F.get(p, 1).between(box[2], box[3]))), lambda e: _text(at(e, "name"))),
        _each(F.when(has("entity_to_token"), F.array_distinct(names)), "name_unmapped", lambda n: ~F.coalesce(F.map_contains_key(c("mapping"), n), F.lit(False)), lambda n: n),
        _each(F.map_entries("mapping"), "mapping_keys", lambda e: ~F.coalesce(F.forall(F.array(*map(F.lit, MAPPING_KEYS)), lambda k: F.map_contains_key(F.try_variant_get(e["value"], "$", "map<string,variant>"), k)), F.lit(False)), lambda e: e["key"]),
        _each(F.when(F.size("tokens") > 0, c("tokens")), "token_not_in_question", lambda t: ~F.contains(c("question"), t), lambda t: t),
    ]
    none = F.array().cast("array<struct<check:string,detail:string>>")
    found = F.concat(F.array_compact(flat), *[F.coalesce(x, none) for x in lists])
    return rows.select("record_id", "relation", F.explode(found).alias("f")).select("record_id", F.coalesce("relation", F.lit("unknown")).alias("relation"), "f.*")


def rates(lines: DataFrame, found: DataFrame, group: str = "relation", text: str = "text") -> DataFrame:
    """(group, check, findings, records, rate): for each check how many findings and records with one, and the share of the group's records without."""
    v = F.try_parse_json(f"`{text}`")
    total = lines.where(F.schema_of_variant(v).startswith("OBJECT")).groupBy(F.coalesce(F.try_variant_get(v, "$.spatial_relation_type", "string"), F.lit("unknown")).alias(group)).agg(F.count("*").alias("n"))
    per = found.groupBy(group, "check").agg(F.count("*").alias("findings"), F.count_distinct("record_id").alias("records"))
    return per.join(total, group).select(group, "check", "findings", "records", (1 - F.col("records") / F.col("n")).alias("rate"))


def without_fields(lines: DataFrame, fields: Iterable[str] = tuple(INTERNAL_FIELDS), text: str = "text") -> DataFrame:
    """The JSON objects without internal fields, whatever other fields they have; keys and values of the others stay as they are."""
    kept = F.map_filter(F.try_variant_get(F.try_parse_json(f"`{text}`"), "$", "map<string,variant>"), lambda k, _: ~k.isin(list(fields)))
    return lines.withColumn(text, F.to_json(kept))


def accepted(rows: DataFrame, sizes: dict[str, int], shares: dict[str, dict[str, float]], pair: str, tolerance: float = 0.05, split: str = "split") -> DataFrame:
    """(check, scope, target, actual, ok) of a finished dataset: the rows of each split and of all against exact sizes; the shares of each column's values in
    all rows against their targets, within the tolerance; and for every two splits the number of pairs that both have, which must be none. Rows without a pair share none."""
    spark = rows.sparkSession
    goals = spark.createDataFrame([("count", k, float(n)) for k, n in [*sizes.items(), ("total", sum(sizes.values()))]], "check string, scope string, target double")
    counts = rows.groupBy(F.col(split).alias("scope")).agg(F.count("*").cast("double").alias("actual"))
    counts = counts.union(rows.agg(F.lit("total"), F.count("*").cast("double")))
    out = goals.join(counts, "scope", "left").select("check", "scope", "target", F.coalesce("actual", F.lit(0.0)).alias("actual"), F.coalesce(F.col("actual") == F.col("target"), F.col("target") == 0).alias("ok"))
    total = rows.agg(F.count("*").alias("rows"))
    for column, target in shares.items():
        want = spark.createDataFrame([(f"share of {column}", k, s) for k, s in target.items()], "check string, scope string, target double")
        have = rows.groupBy(F.col(column).alias("scope")).agg(F.count("*").alias("n"))
        share = want.join(have, "scope", "left").crossJoin(total).withColumn("actual", F.coalesce(F.col("n") / F.nullif("rows", F.lit(0)), F.lit(0.0)))
        out = out.union(share.select("check", "scope", "target", "actual", F.abs(F.col("actual") - F.col("target")) <= tolerance))
    held = rows.where(F.col(pair).isNotNull()).groupBy(pair).agg(F.array_sort(F.collect_set(split)).alias("s"))
    both = held.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: a < b), lambda b: F.concat_ws(" & ", a, b))))).alias("scope"))
    names = sorted(sizes)
    every = spark.createDataFrame([(f"{a} & {b}",) for a in names for b in names if a < b], "scope string")
    shared = every.join(both.groupBy("scope").agg(F.count("*").alias("n")), "scope", "left").select(F.lit("shared pairs"), "scope", F.lit(0.0), F.coalesce("n", F.lit(0)).cast("double").alias("actual"))
    return out.union(shared.withColumn("ok", F.col("actual") == 0))
