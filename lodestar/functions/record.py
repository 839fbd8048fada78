"""Derived fields of question/answer records and entity pairs. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vocabulary as V


def infer_relation(question: Column, answer: Column) -> Column:
    """Relation type by ordered keywords: distance words before topological before directional words, else composite."""
    both = F.lower(F.concat(question, F.lit(" "), answer))
    return F.coalesce(T.first_match(both, {"metric": V.INFER_METRIC, "topological": V.INFER_TOPOLOGY, "directional": V.INFER_DIRECTION}), F.lit("composite"))


def relation_or_inferred(given: Column, label: Column, *texts: Column) -> Column:
    """A given type, whatever it is; else composite if a word of combination occurs in question, answer or reasoning; else
    the type that a relation label names; else composite."""
    both = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return F.coalesce(given, F.when(T.contains_any(both, V.COMBINING), F.lit("composite")), T.first_match(F.lower(F.coalesce(label, F.lit(""))), V.LABEL_TYPES), F.lit("composite"))


def infer_difficulty(n_entities: Column, length: Column) -> Column:
    return F.when((n_entities >= 3) | (length > 300), "hard").when((n_entities == 2) & (length > 150), "medium").otherwise("easy")


def estimate_difficulty(question: Column, answer: Column) -> Column:
    """Points for long questions and answers and for words of complexity; up to 1 easy, up to 3 medium."""
    point = lambda c: F.when(c, 1).otherwise(0)
    points = point(F.char_length(question) > 100) + point(F.char_length(question) > 200) + F.size(T.words_in(question, V.COMPLEX_WORDS)) + point(F.char_length(answer) > 200)
    return F.when(points <= 1, "easy").when(points <= 3, "medium").otherwise("hard")


def difficulty_score(relation: Column, subtype: Column, types: Column, strict_compat: bool = False) -> Column:
    """Base by relation, bonus by topological subtype and by the first two entity types, 0.3 for each entity beyond two; 1 to 5.

    Pair bonuses hold in either order. With strict_compat the pair is looked up sorted, so that
    only keys that are stored sorted can match and the rest take the default, 0.5.
    """
    pairs = {"|".join(sorted(k)): v for k, v in V.PAIR_BONUS.items()}
    if strict_compat:
        pairs = {"|".join(k): v for k, v in V.PAIR_BONUS.items() if tuple(sorted(k)) == k}
    bonus = F.when(F.size(types) >= 2, F.coalesce(T.lookup(T.pair_key(types), pairs), F.lit(0.5))).otherwise(0.0)
    total = F.coalesce(T.lookup(relation, V.BASE_SCORES), F.lit(2.0)) + F.coalesce(T.lookup(subtype, V.TOPOLOGY_BONUS), F.lit(0.0)) + bonus
    return F.least(F.greatest(total + F.greatest(F.size(types) - 2, F.lit(0)) * 0.3, F.lit(1.0)), F.lit(5.0))


def level_of(score: Column) -> Column:
    return F.when(score <= 1.3, "easy").when(score <= 3.1, "medium").otherwise("hard")


def score_of_level(level: Column, relation: Column, subtype: Column, given: Column) -> Column:
    """A score for records that have none: the level's base with half of the relation's and 0.3 of the subtype's bonus."""
    made = F.coalesce(T.lookup(level, V.LEVEL_BASE), F.lit(2.75)) + 0.5 * (F.coalesce(T.lookup(relation, V.BASE_SCORES), F.lit(2.0)) - 1) + 0.3 * F.coalesce(T.lookup(subtype, V.TOPOLOGY_BONUS), F.lit(0.0))
    return F.coalesce(given, F.bround(F.least(F.greatest(made, F.lit(1.0)), F.lit(5.0)), 1))


def spatial_tokens(names: Column, question: Column, answer: Column, most: int = 8) -> Column:
    """Entity names and spatial words found, sorted, at most so many."""
    return F.slice(F.array_sort(F.array_union(names, T.words_in(F.concat(question, F.lit(" "), answer), V.TOKEN_WORDS))), 1, most)


def tokens_in_question(tokens: Column, question: Column) -> Column:
    """The tokens that occur in the question; all of them if none does."""
    found = F.filter(tokens, lambda t: F.contains(question, t))
    return F.when(F.size(found) == 0, tokens).otherwise(found)


def topology_label(label: Column) -> Column:
    clean = F.lower(F.trim(label))
    return F.coalesce(T.lookup(clean, V.TOPOLOGY_LABELS), clean)


def entity_type(kind: Column) -> Column:
    return F.coalesce(T.lookup(kind, V.ENTITY_TYPES), kind)


def fill_subtype(given: Column, answer: Column) -> Column:
    """A missing topological subtype by ordered words of the answer; words of containment come first, as in the data."""
    found = T.first_match(answer, {"within": ["包含", "位于...内"], "disjoint": ["相离", "不包含"], "adjacent": ["相邻", "接壤"], "overlap": ["重叠"]})
    return F.coalesce(F.nullif(given, F.lit("")), found, F.lit("disjoint"))


def five_steps(chain: Column) -> Column:
    """A chain of exactly five steps: those given, then placeholders (array<struct<step, content>>)."""
    return F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(i.alias("step"), F.coalesce(F.get(chain, i - 1)["content"], F.lit("")).alias("content")))


def without_leaks(chain: Column, keys: tuple[str, ...] = ("relation_type", "calculation_result")) -> Column:
    return F.transform(chain, lambda s: s.dropFields(*keys))


def neutral_relation(chain: Column) -> Column:
    """Step 2 names only a spatial relation."""
    return F.transform(chain, lambda s: F.when(s["step"] == 2, s.withField("relation_type", F.lit("spatial"))).otherwise(s))


def neutral_actions(chain: Column) -> Column:
    """Step 4 does not tell by its action which kind of relation is meant."""
    return F.transform(chain, lambda s: F.when(s["step"] == 4, s.withField("action", F.coalesce(T.lookup(s["action"], V.NEUTRAL_ACTIONS), s["action"]))).otherwise(s))


def relation_of_question(question: Column) -> Column:
    """The relation that a question alone shows, composites first; composite if it shows none."""
    return F.coalesce(T.first_match(question, V.QUESTION_RELATIONS), F.lit("composite"))


def coordinates_of(coords: Column, coordinates: Column, point: Column) -> Column:
    """The first of three places that holds [lon, lat], else [0, 0]."""
    return F.coalesce(F.when(F.size(coords) >= 2, coords), F.when(F.size(coordinates) >= 2, F.slice(coordinates, 1, 2)), F.when(F.size(point) >= 2, point), F.array(F.lit(0.0), F.lit(0.0)))


def region_of(lon: Column, lat: Column) -> Column:
    """A region name by longitude, then latitude."""
    name = None
    for bound, ladder, lowest in reversed(V.REGIONS):
        here = F.lit(lowest)
        for at, own, label in reversed(ladder):
            here = F.when((lat >= at) if own else (lat > at), F.lit(label)).otherwise(here)
        name = here if bound is None else F.when(lon < bound, here).otherwise(name)
    return name


def short_relation(relation: Column, negative: Column) -> Column:
    """What follows the last dot, marked if the pair is a negative example."""
    name = F.substring_index(relation, ".", -1)
    return F.when(negative, F.concat(F.lit("negative_"), name)).otherwise(name)


def relation_category(relation: Column) -> Column:
    """The category of a pair's target relation."""
    return (
        F.when(relation.contains("directional"), "directional").when(relation.isin(V.FIRST_CATEGORY), "C1").when(relation.contains("adjacent"), "C2")
        .when(relation.contains("metric"), "metric").when(relation.contains("sameside"), "C4").otherwise("unknown")
    )


def id_prefix(pair_id: Column) -> Column:
    return F.split_part(pair_id, F.lit("_"), F.lit(1))


def id_number(pair_id: Column) -> Column:
    return F.element_at(F.split(pair_id, "_"), -1).try_cast("long")
