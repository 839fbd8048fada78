"""Curated entities held against known facts, one joined pass for all kinds of fact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.functions import vocabulary as V
from lodestar.operators import names

#: How a kind of fact is compared: part (either text in the other, or a leading word of the fact in the value), equal, set, or needed (all that
#: the fact lists must be there). Kinds that are not named here are compared as equal; position has its own rule.
COMPARE = {"origin": "part", "mouth": "part", "peak": "equal", "provinces": "set", "neighbours": "needed"}


def fact_issues(
    attributes: DataFrame, facts: DataFrame, aliases: Mapping[str, list[str]] | None = None, compare: Mapping[str, str] | None = None, degrees: float = 0.5,
    box: tuple[float, float, float, float] = V.CHINA_BOX, far_km: tuple[float, float] = (100.0, 200.0),
) -> DataFrame:
    """(entity, kind, issue, detail, severity) of every value that does not agree with its fact.

    attributes and facts: entity, kind, lon, lat, text, items (array<string>), of which a row uses those of its kind. An entity is found among the facts by its
    name, an alias or without its administrative suffix; values without a fact pass. Issues: ``outside`` (a position out of the box, which is not
    compared further), ``displaced`` (more than `degrees` off in longitude or latitude; critical beyond far_km[1] kilometres, an error beyond far_km[0], else
    a warning), ``empty`` (a value that is null or empty, fact or not), ``different``, ``missing`` and ``extra`` (items, in order). An entity and kind may
    have several facts; each is compared.
    """
    how = F.create_map(*[F.lit(x) for kv in (compare or COMPARE).items() for x in kv])
    known = facts.select(F.col("entity").alias("name"), F.col("kind").alias("fact kind"), *[F.col(c).alias(f"fact {c}") for c in ("lon", "lat", "text", "items")])
    asked = names.lookup(attributes, "entity", known.select("name"), aliases=aliases)
    both = asked.join(known, (F.col("found") == F.col("name")) & (F.col("kind") == F.col("fact kind")), "left")

    c, rule = F.col, F.coalesce(F.try_element_at(how, F.col("kind")), F.lit("equal"))
    place, listed = c("kind") == "position", rule.isin("set", "needed")
    have = F.when(place, c("lon").isNotNull() & c("lat").isNotNull()).when(listed, F.coalesce(F.size("items") > 0, F.lit(False))).otherwise(F.coalesce(c("text") != "", F.lit(False)))
    km = geo.haversine_km(c("lon"), c("lat"), c("fact lon"), c("fact lat"))
    off = (F.abs(c("lon") - c("fact lon")) > degrees) | (F.abs(c("lat") - c("fact lat")) > degrees)
    words = F.slice(F.split("fact text", r"\s+"), 1, 2)
    part = F.contains("text", "fact text") | F.contains("fact text", "text") | F.exists(words, lambda w: F.contains(c("text"), w))
    unlike = F.when(rule == "part", ~part).otherwise(c("text") != c("fact text"))
    missing, extra = F.array_sort(F.array_except("fact items", "items")), F.array_sort(F.array_except("items", "fact items"))

    issue = lambda when, name, detail, severity: F.when(when, F.struct(F.lit(name).alias("issue"), detail.alias("detail"), severity.alias("severity")))
    grade = F.when(km > far_km[1], "critical").when(km > far_km[0], "error").otherwise("warning")
    found = F.array_compact(
        F.array(
            issue(~have, "empty", F.lit(""), F.lit("warning")),
            issue(have & place & ~geo.in_box(c("lon"), c("lat"), box), "outside", F.format_string("%.3f,%.3f", "lon", "lat"), F.lit("critical")),
            issue(have & place & geo.in_box(c("lon"), c("lat"), box) & off, "displaced", F.floor(km).cast("string"), grade),
            issue(have & ~place & ~listed & unlike, "different", F.concat("text", F.lit(" / "), "fact text"), F.lit("error")),
            issue(have & listed & (F.size(missing) > 0), "missing", F.array_join(missing, ","), F.lit("error")),
            issue(have & (rule == "set") & (F.size(extra) > 0), "extra", F.array_join(extra, ","), F.lit("error")),
        )
    )
    return both.select("entity", "kind", F.explode(found).alias("i")).select("entity", "kind", "i.*")


def one_sided(lists: DataFrame) -> DataFrame:
    """(entity, item) where the entity lists the item as a neighbour and the item, which has a list, does not list the entity. lists: entity, items."""
    each = lists.select("entity", F.explode("items").alias("item")).distinct()
    back = each.select(F.col("entity").alias("item"), F.col("item").alias("entity"))
    return each.join(lists.select(F.col("entity").alias("item")).distinct(), "item", "left_semi").join(back, ["entity", "item"], "left_anti").select("entity", "item")
