"""Many names in texts: spans by one automaton, names looked up through their variants, and which names occur at all."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import name_variants

SPANS = "array<struct<name:string,matched:string,char_start:int,char_end:int>>"
#: The most variants that one automaton holds; it is built in every Python worker.
MOST_VARIANTS = 1_000_000


def variants(names: DataFrame, name: str = "name", aliases: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(name, variant, rank) of every name: itself (0), its aliases, then itself without each administrative suffix that it ends in. Null and empty
    names are left out, repeated names count once."""
    each = names.select(F.col(f"`{name}`").alias("name")).where("name <> ''").distinct()
    return each.select("name", F.posexplode(name_variants(F.col("name"), aliases)).alias("rank", "variant")).select("name", "variant", "rank")


def owners(found: DataFrame) -> DataFrame:
    """(variant, name): the name that a variant stands for, which is that of the least rank, and of those the first in order."""
    return found.groupBy("variant").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))


def spans(text: Column, table: Mapping[str, str]) -> Column:
    """Every occurrence of a variant in the text, as array<struct<name, matched, char_start, char_end>> in code points; table: variant to name.

    Of variants that start at one place the longest counts, and spans do not overlap: the search goes on behind each. One pass over the text,
    however many variants there are: an Aho-Corasick automaton, built once in a Python worker, runs over Arrow batches.
    Null texts have null, texts without a name an empty array.
    """
    table = {v: n for v, n in table.items() if v}
    if len(table) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants; split the names")
    held: dict = {}

    @F.arrow_udf(SPANS)
    def search(texts: pa.Array) -> pa.Array:
        import ahocorasick

        if "automaton" not in held:
            automaton = ahocorasick.Automaton()
            for variant in table:
                automaton.add_word(variant, variant)
            if table:
                automaton.make_automaton()
            held["automaton"] = automaton
        automaton, out = held["automaton"], []
        for t in texts.to_pylist():
            if t is None or not table:
                out.append(None if t is None else [])
                continue
            # leftmost, longest: all ends of matches, then by start
            longest: dict[int, str] = {}
            for end, v in automaton.iter(t):
                start = end + 1 - len(v)
                if len(v) > len(longest.get(start, "")):
                    longest[start] = v
            at, own = 0, []
            for start in sorted(longest):
                if start >= at:
                    at = start + len(longest[start])
                    own.append({"name": table[longest[start]], "matched": longest[start], "char_start": start, "char_end": at})
            out.append(own)
        kind = pa.struct([("name", pa.string()), ("matched", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])
        return pa.array(out, pa.list_(kind))

    return search(text)


def table_of(names: DataFrame, name: str = "name", aliases: Mapping[str, list[str]] | None = None) -> dict[str, str]:
    """The variants of a table of names, for ``spans``: no more than MOST_VARIANTS, or an error."""
    rows = owners(variants(names, name, aliases)).limit(MOST_VARIANTS + 1).collect()
    if len(rows) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants; split the names")
    return {r.variant: r.name for r in rows}


def coverage(texts: DataFrame, text: str, names: DataFrame, name: str = "name", aliases: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(name, n): every listed name and the number of texts that hold it or a variant; names that none holds have 0."""
    found = texts.select(F.explode(F.array_distinct(F.transform(spans(F.col(f"`{text}`"), table_of(names, name, aliases)), lambda s: s["name"]))).alias("name"))
    listed = names.select(F.col(f"`{name}`").alias("name")).where("name <> ''").distinct()
    return listed.join(found.groupBy("name").agg(F.count("*").alias("n")), "name", "left").na.fill(0, ["n"])


def lookup(rows: DataFrame, wanted: str, known: DataFrame, group: str | None = None, aliases: Mapping[str, list[str]] | None = None) -> DataFrame:
    """rows with the columns ``found`` (the known name) and ``how`` (name, alias or suffix; null if nothing fits).

    known: a column name and, with `group`, that column too, which must then be equal. A wanted value is compared with the
    names, then with their variants, and its own suffixes are taken off last; the first way that fits counts, and the first name in order. Equi-joins on the distinct
    wanted values, whatever their number.
    """
    keys = [group] if group else []
    own = known.select(*keys, "name").where("name <> ''").distinct()
    listed = own.select(*keys, "name", F.posexplode(name_variants(F.col("name"), aliases)).alias("rank", "variant"))
    asked = rows.select(*keys, F.col(f"`{wanted}`").alias("asked")).where("asked <> ''").distinct()
    tried = asked.select(*keys, "asked", F.posexplode(name_variants(F.col("asked"))).alias("tries", "variant"))
    best = F.struct((F.col("tries") > 0).alias("cut"), "rank", "tries", "name")
    hits = tried.join(listed, [*keys, "variant"]).groupBy(*keys, "asked").agg(F.min(best).alias("best"))
    alias = F.exists(F.coalesce(*[F.when(F.col("best.name") == k, F.array(*map(F.lit, v))) for k, v in (aliases or {}).items()], F.array().cast("array<string>")), lambda a: a == F.col("asked"))
    how = F.when(F.col("best.name") == F.col("asked"), "name").when(alias, "alias").otherwise("suffix")
    named = hits.select(*[F.col(k).alias(f"key of {k}") for k in keys], F.col("asked").alias("asked for"), F.col("best.name").alias("found"), how.alias("how"))
    match = F.col(f"`{wanted}`") == F.col("`asked for`")
    for k in keys:
        match &= F.col(f"`{k}`") == F.col(f"`key of {k}`")
    return rows.join(named, match, "left").select(*[F.col(f"`{c}`") for c in rows.columns], "found", "how")
