"""Answer scoring: typed correctness, format, n-gram overlap, keyword agreement. All are Columns.

Three generations of the scorer exist and differ; version="v2" is the default of the operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.functions.let import let

#: Direction words, longest first, with the main direction of each.
_MAIN = {w: k for w in T.longest_first(V.DIRECTIONS_20) for k, group in V.DIRECTION_GROUPS.items() if w in group}


def main_direction(col: Column) -> Column:
    """The main direction that the first direction word in a text, longest words first, stands for."""
    return F.coalesce(*[F.when(col.contains(w), F.lit(k)) for w, k in _MAIN.items()])


def plain(col: Column) -> Column:
    return F.lower(F.trim(col))


def direction_correct(prediction: Column, reference: Column) -> Column:
    """Both name a direction (longest word first) and the words mean the same."""
    return F.coalesce(main_direction(prediction) == main_direction(reference), F.lit(False))


def topology_correct(prediction: Column, reference: Column, table: dict[str, list[str]] = V.TOPOLOGY_WORDS, shared: list[str] | None = None) -> Column:
    """Both are of one topological type, types being tried in table order; if a type is unknown, whether they share a
    word of `shared` (with None: no)."""
    p, r = T.first_match(prediction, table), T.first_match(reference, table)
    other = F.lit(False) if shared is None else F.exists(T.words_in(prediction, shared), lambda w: F.contains(reference, w))
    return F.when(p.isNull() | r.isNull(), other).otherwise(p == r)


def distance_correct(prediction: Column, reference: Column, share: float = 0.15, least_km: float = 50.0, with_units: bool = False) -> Column:
    """The first distances differ by at most the greater of a share of the reference and a fixed length."""
    read = T.distance_with_unit if with_units else T.first_number
    p, r = read(prediction), read(reference)
    return F.coalesce(F.abs(p - r) <= F.greatest(r * share, F.lit(least_km)), F.lit(False))


def correct_v2(kind: Column, prediction: Column, reference: Column, configured: list[str] | None = None) -> Column:
    """Equal texts are right; else the rule of the relation type; texts of unknown type are right if one contains the other."""
    p, r = plain(prediction), plain(reference)
    direction, distance = direction_correct(p, r), distance_correct(p, r)
    return (
        F.when(p == r, F.lit(True)).when(kind == "directional", direction)
        .when(kind == "topological", topology_correct(p, r, shared=configured or V.TOPOLOGY_CONFIGURED))
        .when(kind == "metric", distance).when(kind == "composite", direction & distance).otherwise(F.contains(p, r) | F.contains(r, p))
    )


def correct_v1(kind: Column, prediction: Column, reference: Column) -> Column:
    """First direction word in list order (single characters first), topology without fallback, distances with units; other types are wrong."""
    first = lambda c: T.first_word(c, V.DIRECTIONS_8)
    direction = F.coalesce(first(prediction) == first(reference), F.lit(False))
    distance = distance_correct(prediction, reference, 0.10, 50.0, with_units=True)
    return (
        F.when(kind == "directional", direction).when(kind == "topological", topology_correct(prediction, reference, V.TOPOLOGY_WORDS_V1))
        .when(kind == "metric", distance).when(kind == "composite", direction & distance).otherwise(F.lit(False))
    )


def correct_by_runs(prediction: Column, reference: Column) -> Column:
    """An identical run of Han characters occurs in both."""
    runs = lambda c: F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0))
    return F.arrays_overlap(runs(prediction), runs(reference))


def reasoning_correct(prediction: Column, reference: Column) -> Column:
    """Equal, or contained, or the same set of numbers, or a shared direction word (earliest scorer)."""
    p, r = F.trim(prediction), F.trim(reference)
    digits = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))))
    same = (F.size(digits(r)) > 0) & (digits(p) == digits(r))
    return (p == r) | F.contains(p, r) | same | F.exists(T.words_in(r, V.DIRECTIONS_8), lambda w: F.contains(p, w))


def format_valid(prediction: Column) -> Column:
    """At least two characters, no error mark, and a Han character or digit."""
    p = F.trim(F.coalesce(prediction, F.lit("")))
    return (F.char_length(p) >= 2) & ~p.startswith("ERROR:") & p.rlike("[\\u4e00-\\u9fff0-9]")


def _precision(prediction: Column, reference: Column, n: int) -> Column:
    """Clipped precision of the character n-grams.

    Both texts' n-grams are sorted together, marked by side; a run of equal ones gives the lesser of its two counts. So a
    row costs n log n in its length.
    """
    side = lambda c, k: F.transform(T.char_ngrams(c, n), lambda g: F.struct(g.alias("g"), F.lit(k).alias("k")))
    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("hits"))

    def step(a: Column, x: Column) -> Column:
        same = a["g"].eqNullSafe(x["g"])
        one = F.when(same, a["one"]).otherwise(0) + F.when(x["k"] == 1, 1).otherwise(0)
        two = F.when(same, a["two"]).otherwise(0) + F.when(x["k"] == 2, 1).otherwise(0)
        # the prediction's n-grams come first in a run, so each of the reference's that finds one left is a hit
        hit = F.when((x["k"] == 2) & (two <= one), 1).otherwise(0)
        return F.struct(x["g"].alias("g"), one.alias("one"), two.alias("two"), (a["hits"] + hit).alias("hits"))

    both = F.array_sort(F.concat(side(prediction, 1), side(reference, 2)))
    hits = F.aggregate(both, start, step)["hits"]
    total = F.char_length(prediction) - (n - 1)
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def bleu(prediction: Column, reference: Column, order: int = 4, smoothing: float = 0.0, strict_penalty: bool = False) -> Column:
    """Character BLEU with clipped counts: the geometric mean of the precisions times the brevity penalty.

    Without smoothing a zero precision makes the score 0; the penalty is exp(1 - r/c) if c <= r (strict_penalty: c < r).
    """
    c, r = F.char_length(prediction).cast("double"), F.char_length(reference).cast("double")

    parts = [_precision(prediction, reference, n) for n in range(1, order + 1)]
    if smoothing:
        parts = [F.greatest(p, F.lit(smoothing)) for p in parts]
    logs = sum((F.ln(F.nullif(p, F.lit(0.0))) for p in parts[1:]), F.ln(F.nullif(parts[0], F.lit(0.0))))
    brief = (c < r) if strict_penalty else (c <= r)
    penalty = F.when(brief, F.exp(1 - r / F.nullif(c, F.lit(0.0)))).otherwise(F.lit(1.0))
    return F.coalesce(F.exp(logs / order) * penalty, F.lit(0.0))


def bleu_plain(prediction: Column, reference: Column, order: int = 4) -> Column:
    """The earliest BLEU: the geometric mean of the character precisions, or their plain mean if one is 0; no penalty."""
    parts = F.array(*[_precision(prediction, reference, n) for n in range(1, order + 1)])
    geometric = F.exp(F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.ln(x)) / order)
    return F.when(F.forall(parts, lambda x: x > 0), geometric).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / order)


def keyword_counts(prediction: Column, reference: Column, words: list[str]) -> tuple[Column, Column, Column]:
    """(true positives, false positives, false negatives) over the words that occur in the two texts."""
    p, r = T.words_in(prediction, words), T.words_in(reference, words)
    both = F.size(F.array_intersect(p, r))
    return both, F.size(p) - both, F.size(r) - both


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 tp / (2 tp + fp + fn), 0 if there is none."""
    return F.coalesce(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))


def keyword_f1_macro(prediction: Column, reference: Column, words: list[str]) -> Column:
    """F1 of one row; 1 if the reference has none of the words."""
    tp, fp, fn = keyword_counts(prediction, reference, words)
    return F.when(tp + fn == 0, F.lit(1.0)).otherwise(f1(tp, fp, fn))


def error_parts(prediction: Column, reference: Column) -> dict[str, Column]:
    """What error_cause looks at, to be computed once as columns."""
    return {
        "p_direction": main_direction(prediction), "r_direction": main_direction(reference), "p_number": T.first_number(prediction), "r_number": T.first_number(reference),
        "p_topology": T.first_match(prediction, V.TOPOLOGY_WORDS),
    }


def error_cause(kind: Column, part: dict[str, Column]) -> Column:
    """Why a wrong answer is wrong, by relation type, from its error_parts."""
    same = F.coalesce(part["p_direction"] == part["r_direction"], F.lit(False))
    near = F.coalesce(F.abs(part["p_number"] - part["r_number"]) <= F.greatest(part["r_number"] * 0.15, F.lit(50.0)), F.lit(False))
    direction = F.when(part["p_direction"].isNull(), "direction_missing").when(~same, "direction_wrong")
    distance = F.when(part["p_number"].isNull(), "distance_missing").when(~near, "distance_wrong")
    topology = F.when(part["p_topology"].isNull(), "topology_missing").otherwise("topology_wrong")
    cause = F.when(kind == "directional", direction).when(kind == "metric", distance).when(kind == "topological", topology).otherwise(F.concat_ws("；", direction, distance))
    return F.coalesce(F.nullif(cause, F.lit("")), F.lit("other"))


def loosely_correct(kind: Column, prediction: Column, reference: Column) -> Column:
    """A shared direction character; first numbers within 10 %, or 15 % in composites; both texts of one word group
    (affirming, denying, adjoining); other kinds are wrong."""
    p, r = F.lower(F.trim(prediction)), F.lower(F.trim(reference))
    shared = F.exists(T.words_in(r, ["东", "西", "南", "北"]), lambda w: F.contains(p, w))
    one, two = T.first_number(p), T.first_number(r)
    near = lambda share: F.coalesce(F.abs(one - two) / F.nullif(two, F.lit(0.0)) <= share, F.lit(False))
    group = reduce(lambda a, b: a | b, [T.contains_any(p, g) & T.contains_any(r, g) for g in V.LOOSE_TOPOLOGY])
    return F.when(kind == "directional", shared).when(kind == "metric", near(0.10)).when(kind == "composite", shared & near(0.15)).when(kind == "topological", group).otherwise(F.lit(False))


def study_correct(kind: Column, prediction: Column, reference: Column) -> Column:
    """Equal; or a shared direction character; or any two whole numbers less than 50 apart; or a shared topological word.
    Composites must be equal."""
    equal = F.lower(F.trim(prediction)) == F.lower(F.trim(reference))
    shared = lambda words: F.exists(T.words_in(reference, words), lambda w: F.contains(prediction, w))
    whole = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))
    near = F.exists(whole(reference), lambda a: F.exists(whole(prediction), lambda b: F.abs(a - b) < 50))
    own = F.when(kind == "directional", shared(["东", "西", "南", "北"])).when(kind == "metric", near).when(kind == "topological", shared(V.STUDY_TOPOLOGY)).otherwise(F.lit(False))
    return equal | own


def spatial_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the spatial words of two texts; 1 if neither has any."""
    tp, fp, fn = keyword_counts(prediction, reference, V.SPATIAL_WORDS)
    return F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(f1(tp, fp, fn))


def direction_flexible(prediction: Column, reference: Column) -> Column:
    """Equal, or contained, or the reference's direction occurs in the prediction; a single character only where no longer
    direction with it does."""
    p, r = T.strip_stop(F.trim(prediction)), T.strip_stop(F.trim(reference))
    word = T.first_word(F.replace(r, F.lit("方向"), F.lit("")), V.FLEXIBLE_DIRECTIONS)
    longer = F.exists(F.array(*map(F.lit, V.FLEXIBLE_DIRECTIONS)), lambda d: (F.char_length(d) > F.char_length(word)) & F.contains(d, word) & F.contains(p, d))
    found = F.contains(p, word) & ((F.char_length(word) >= 2) | ~longer)
    return F.contains(p, r) | F.coalesce(found, F.lit(False))


def parsed_direction(text: Column) -> Column:
    """The first parser's direction: two-character ones before single ones."""
    return T.first_match(F.lower(F.trim(text)), V.PARSER_DIRECTIONS)


def parsed_topology(text: Column) -> Column:
    return T.first_match(F.lower(F.trim(text)), V.PARSER_TOPOLOGY)


def parsed_km(text: Column) -> Column:
    """The first parser's distance in kilometres, by the first unit in order that follows a number."""
    number = lambda unit: F.nullif(F.regexp_extract(F.lower(text), rf"(\d+(?:\.\d+)?)\s*{unit}", 1), F.lit("")).cast("double")
    return F.coalesce(*[number(unit) * k for unit, k in V.PARSER_UNITS])


def parsed_match(kind: Column, prediction: Column, reference: Column) -> Column:
    """The first parser's comparison by kind: direction, topology, distance (5 %, 1 km at least), else equal texts; of the kind
    auto, the first that the reference has."""
    direction, topology, km = parsed_direction(reference), parsed_topology(reference), parsed_km(reference)
    auto = F.when(direction.isNotNull(), "direction").when(topology.isNotNull(), "topology").when(km > 0, "distance").otherwise("text")
    kind = F.when(kind == "auto", auto).otherwise(kind)
    near = (km > 0) & (parsed_km(prediction) > 0) & (F.abs(parsed_km(prediction) - km) <= F.greatest(km * 0.05, F.lit(1.0)))
    same = F.lower(F.trim(prediction)) == F.lower(F.trim(reference))
    match = F.when(kind == "direction", parsed_direction(prediction) == direction).when(kind == "topology", parsed_topology(prediction) == topology).when(kind == "distance", near).otherwise(same)
    return F.coalesce(match, F.lit(False)) & (F.char_length(prediction) > 0) & (F.char_length(reference) > 0)


def answer_shown(text: Column) -> Column:
    """Whether a reply holds an object that parses as JSON, or a word of an answer."""
    fenced = F.regexp_extract(text, r"```json\s*([\s\S]*?)\s*```", 1)
    loose = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    parses = lambda c: F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull()
    return parses(fenced) | parses(loose) | T.contains_any(text, V.ANSWER_WORDS)


def valid_by_words(prediction: Column) -> Column:
    """No error mark at the start, and a word of an answer (built-in scorer)."""
    return ~prediction.startswith("[API_ERROR]") & T.contains_any(prediction, V.RUN_FORMAT_WORDS)


def run_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the keywords that are whole runs of Han characters; 1 if neither text has any (built-in scorer)."""
    words = lambda c: F.array_intersect(F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0)), F.array(*map(F.lit, V.RUN_WORDS)))
    both = F.struct(words(prediction).alias("p"), words(reference).alias("r"))

    def score(b: Column) -> Column:
        n, common = F.size(b["p"]) + F.size(b["r"]), F.size(F.array_intersect(b["p"], b["r"]))
        return F.when(n == 0, 1.0).otherwise(2 * common / F.nullif(n, F.lit(0)))

    return let(both, score)
