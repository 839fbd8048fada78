"""Reasoning chains: arrays of steps, each a map of its fields to text. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import vocabulary as V

LEAKS = ("relation_type", "calculation_result")


def has_length(chain: Column, steps: int = 5) -> Column:
    return F.coalesce(F.size(chain) == steps, F.lit(False))


def gaps(chain: Column) -> Column:
    """What each incomplete step lacks, as "number:fields": the fields that all steps have, or else the step's own."""

    def lacking(step: Column, i: Column) -> Column:
        known = F.map_keys(step)
        common = F.array_except(F.array(*map(F.lit, V.STEP_FIELDS)), known)
        own = F.array()
        for number, field in V.STEP_EXTRA.items():
            own = F.when(i == number - 1, F.array_except(F.array(F.lit(field)), known)).otherwise(own)
        missing = F.when(F.size(common) > 0, common).otherwise(own)
        return F.when(F.size(missing) > 0, F.concat((i + 1).cast("string"), F.lit(":"), F.array_join(missing, ",")))

    return F.array_compact(F.transform(chain, lacking))


def leaks(chain: Column) -> Column:
    """Whether a step names the relation type or the result."""
    return F.exists(chain, lambda s: F.arrays_overlap(F.map_keys(s), F.array(*map(F.lit, LEAKS))))


def is_whole(chain: Column, steps: int = 5) -> Column:
    """Of the right length, every step with all common fields."""
    common = F.array(*map(F.lit, V.STEP_FIELDS))
    return has_length(chain, steps) & F.forall(chain, lambda s: F.size(F.array_except(common, F.map_keys(s))) == 0)


def displaced(stated: Column, known: Column, tolerance: float = 0.01) -> Column:
    """Names whose stated [lon, lat] differs from the known one by the tolerance or more; names without a known place pass.
    Both are maps from name to array<double>."""
    off = lambda n: F.exists(F.arrays_zip(stated[n].alias("a"), known[n].alias("b")), lambda z: F.abs(z["a"] - z["b"]) >= tolerance)
    return F.filter(F.map_keys(stated), lambda n: F.coalesce(off(n), F.lit(False)))


def unmapped(names: Column, mapping: Column) -> Column:
    """The distinct names without an entry in the mapping."""
    return F.array_except(names, F.map_keys(mapping))


def same_answer(answer: Column, final: Column) -> Column:
    """Equal, or one within the other, without punctuation and white space."""
    bare = lambda c: F.regexp_replace(c, r"[，。！？、\s]", "")
    return F.contains(bare(answer), bare(final)) | F.contains(bare(final), bare(answer))


def polarity_fits(subtype: Column, answer: Column) -> Column:
    """A disjoint pair is not affirmed, and no other pair is denied."""
    yes, no = (F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(answer, w)) for words in (V.AFFIRMING, V.DENYING))
    wrong = ((subtype == "disjoint") & yes & ~no & ~answer.contains("不")) | (subtype.isin("within", "contains", "adjacent", "overlap") & no & ~yes)
    return ~F.coalesce(wrong, F.lit(False))


def direction_worded(text: Column) -> Column:
    """Not only worded in a way other than the eight directions. Each of the other words holds a letter of the eight, so they are struck out
    before one of the eight is looked for; without that no text could fail."""
    odd = "|".join(V.NON_STANDARD_DIRECTIONS)
    rest = F.regexp_replace(text, odd, "")
    return ~text.rlike(odd) | F.exists(F.array(*map(F.lit, V.DIRECTIONS_8)), lambda w: F.contains(rest, w))
