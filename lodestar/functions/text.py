"""Text expressions: ordered keyword matching, extraction, rewriting, n-grams. All are Columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import vocabulary as V


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs literally."""
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def first_match(col: Column, rules: Mapping[str, Iterable[str]]) -> Column:
    """The label of the first rule of which a word occurs; null if none does. The order of the rules is their meaning."""
    pairs = [(label, contains_any(col, words)) for label, words in rules.items()]
    return reduce(lambda tail, p: F.when(p[1], F.lit(p[0])).otherwise(tail), reversed(pairs), F.lit(None).cast("string"))


def first_word(col: Column, words: Iterable[str]) -> Column:
    """The first of the words, in their order, that occurs."""
    return F.coalesce(*[F.when(col.contains(w), F.lit(w)) for w in words])


def longest_first(words: Iterable[str]) -> list[str]:
    return sorted(words, key=len, reverse=True)


def words_in(col: Column, words: Iterable[str]) -> Column:
    """Which of the words occur, as an array in their order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(col, w))


def lookup(col: Column, table: Mapping[str, object]) -> Column:
    """Table value by key; null for other keys."""
    return reduce(lambda tail, kv: F.when(col == kv[0], F.lit(kv[1])).otherwise(tail), table.items(), F.lit(None))


def strip_stop(col: Column) -> Column:
    """Without final full stops of either script."""
    return F.regexp_replace(col, "[。.]+$", "")


def numbers(col: Column) -> Column:
    """All decimal numbers, as doubles."""
    return F.transform(F.regexp_extract_all(col, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def first_number(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def _captured(col: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")).cast("double")


def distance_in_text(col: Column, patterns: Iterable[str] = tuple(V.DISTANCE_PATTERNS)) -> Column:
    """Kilometres by the first pattern that matches."""
    return F.coalesce(*[_captured(col, p) for p in patterns])


def distance_with_unit(col: Column) -> Column:
    """Kilometres by the first unit, in order of preference, that follows a number; metres are converted."""
    return F.coalesce(*[_captured(col, p) * F.lit(k) for p, k in V.UNIT_PATTERNS])


def rewrite(col: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Ordered regular-expression substitutions; {n} in a replacement is the n-th group."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1].replace("{1}", "$1")), rules, col)


def without_bias(question: Column) -> Column:
    """A question without leading phrases and white space."""
    return rewrite(question, V.BIAS_RULES)


def has_coordinates(question: Column) -> Column:
    return question.rlike("|".join(f"(?:{p})" for p in V.COORDINATE_PATTERNS))


def without_coordinates(question: Column) -> Column:
    return rewrite(question, [(p, "") for p in V.COORDINATE_REMOVALS])


def name_variants(name: Column, aliases: Mapping[str, list[str]] | None = None) -> Column:
    """The name, its known aliases, and the name without each administrative suffix that it ends in."""
    known = [F.when(name == k, F.array(*map(F.lit, v))) for k, v in (aliases or {}).items()]
    stripped = [F.when(name.endswith(s) & (F.char_length(name) > len(s)), F.left(name, F.char_length(name) - len(s))) for s in V.ADMINISTRATIVE_SUFFIXES]
    alias = F.coalesce(*known, F.array().cast("array<string>")) if known else F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(F.array(name), alias, F.array(*stripped))))


def inline_coordinates(question: Column, entities: Column) -> Column:
    """Every entity name (longest first) followed by its (lon,lat); entities: array<struct<name, lon, lat>>."""
    ranked = F.array_sort(entities, lambda a, b: F.char_length(b["name"]) - F.char_length(a["name"]))
    return F.aggregate(ranked, question, lambda q, e: F.replace(q, e["name"], F.format_string("%s(%.4f,%.4f)", e["name"], e["lon"], e["lat"])))


def longest_prefix(name: Column, text: Column) -> Column:
    """The longest prefix of the name, down to one character, that occurs in the text."""
    sizes = F.when(F.char_length(name) > 0, F.sequence(F.char_length(name), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(F.transform(sizes, lambda k: F.substr(name, F.lit(1), k)), lambda p: F.contains(text, p)), F.lit(0))


def span(name: Column, text: Column) -> Column:
    """struct<char_start, char_end, token_indices> of the first occurrence (code points from 0); null if absent."""
    start = F.instr(text, name) - 1
    end = start + F.char_length(name)
    return F.when((start >= 0) & (F.char_length(name) > 0), F.struct(start.alias("char_start"), end.alias("char_end"), F.sequence(start, end - 1).alias("token_indices")))


def char_ngrams(col: Column, n: int) -> Column:
    """All windows of n code points."""
    count = F.char_length(col) - (n - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(col, i, F.lit(n)))


def pair_key(names: Column) -> Column:
    """The first two names, sorted; null if there are fewer."""
    return F.when(F.size(names) >= 2, F.array_join(F.array_sort(F.slice(names, 1, 2)), "|"))
