"""Audits as tables of rules: every rule is a Boolean Column, and all rules of a table run in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A check: `ok` is true where a record passes; null counts as a failure. `applies` restricts it to some records."""

    name: str
    ok: Column
    severity: str = "error"
    level: int = 1
    applies: Column | None = None
    detail: Column | None = None
    least_rate: float = 1.0


def _failed(rule: Rule) -> Column:
    fails = ~F.coalesce(rule.ok, F.lit(False))
    return fails if rule.applies is None else fails & F.coalesce(rule.applies, F.lit(False))


def issues(df: DataFrame, rules: list[Rule], id_col: str = "id") -> DataFrame:
    """One row per record and failed rule: record_id, check_name, level, severity, detail."""
    found = [
        F.when(
            _failed(r),
            F.struct(F.lit(r.name).alias("check_name"), F.lit(r.level).alias("level"), F.lit(r.severity).alias("severity"), (r.detail if r.detail is not None else F.lit(None)).cast("string").alias("detail")),
        )
        for r in rules
    ]
    return df.select(F.col(id_col).alias("record_id"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("record_id", "i.*")


def pass_rates(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule: check_name, total, failed, pass_rate, passed (the rate reaches the rule's least rate)."""
    aggregates = []
    for i, r in enumerate(rules):
        applies = F.lit(True) if r.applies is None else F.coalesce(r.applies, F.lit(False))
        aggregates += [F.count_if(applies).alias(f"t{i}"), F.count_if(_failed(r)).alias(f"f{i}")]
    rows = [F.struct(F.lit(r.name).alias("check_name"), F.col(f"t{i}").alias("total"), F.col(f"f{i}").alias("failed"), F.lit(r.least_rate).alias("least")) for i, r in enumerate(rules)]
    out = df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    rate = F.coalesce(1 - F.col("failed") / F.nullif(F.col("total"), F.lit(0)), F.lit(1.0))
    return out.withColumn("pass_rate", rate).withColumn("passed", F.col("pass_rate") >= F.col("least")).drop("least")


def partition_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows)."""
    bad = F.lit(False)
    for r in rules:
        bad = bad | _failed(r)
    return df.where(~bad), df.where(bad)


def duplicates(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Keys that occur more than once, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def direction_free_key(relation: Column, one: Column, two: Column, unordered: list[str]) -> Column:
    """A pair's key: without order for symmetric relations, in order for the others."""
    return F.when(relation.isin(unordered), F.concat_ws("|", F.least(one, two), F.greatest(one, two))).otherwise(F.concat_ws("|", one, two))


def attribute_conflicts(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Keys whose attribute takes more than one value: key, attribute, n_values."""
    sides = df.select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])).alias("x")).select(key, "x.*")
    return sides.groupBy(key, "attribute").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def id_gaps(df: DataFrame, prefix: str, number: str) -> DataFrame:
    """Missing runs of numbers by prefix: prefix, after, before, missing."""
    following = F.expr(f"lead({number}) over (partition by {prefix} order by {number})")
    return df.select(prefix, number).distinct().withColumn("before", following).where(F.col("before") - F.col(number) > 1).select(prefix, F.col(number).alias("after"), "before", (F.col("before") - F.col(number) - 1).alias("missing"))
