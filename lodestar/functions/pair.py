"""Rules of the entity-pair layer: facts that relations require, denials, references. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vocabulary as V


def required_facts(relation: Column) -> Column:
    """The facts that a pair must state, by the parts of its relation's name."""
    low = F.lower(relation)
    needed = [F.when(T.contains_any(low, parts), F.array(*map(F.lit, facts))).otherwise(F.array().cast("array<string>")) for parts, facts in V.REQUIRED_FACTS]
    return F.array_distinct(F.concat(*needed))


def missing_facts(relation: Column, facts: Column) -> Column:
    """The required facts that a map of facts does not have."""
    return F.array_except(required_facts(relation), F.map_keys(facts))


def affirmed_facts(facts: Column) -> Column:
    """The facts of a negative example that are not false."""
    return F.map_keys(F.map_filter(facts, lambda _, v: ~v.eqNullSafe(F.lit("false"))))


def reference_fits(relation: Column, reference: Column) -> Column:
    """A reference entity is present, except with relations that have none."""
    without = T.contains_any(F.lower(relation), ["metric", "touches", "disjoint"])
    return without | (F.coalesce(reference, F.lit("")) != "")


def stated_fields(direction: Column, distance: Column, within: Column) -> Column:
    """Which of direction, distance and range a pair states, joined by "+"; null if fewer than two."""
    names = F.array_compact(F.array(F.when(direction.isNotNull(), "direction"), F.when(distance.isNotNull(), "distance"), F.when(within.isNotNull(), "within")))
    return F.when(F.size(names) >= 2, F.array_join(names, "+"))


def negative_fits(negative: Column, file: Column) -> Column:
    """In a file whose name says negative every pair is marked so; elsewhere none is."""
    said = F.contains(F.lower(file), F.lit("negative"))
    return F.when(said, negative.eqNullSafe(F.lit(True))).otherwise(~negative.eqNullSafe(F.lit(True)))
