"""Joins of the record and entity layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.geo import in_ring
from lodestar.operators.spatial import Classes, candidates, expanded_smaller_first
from lodestar.sources.scratch import stored


def overlay(base: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with columns replaced by new's values where new has a row and a value for the key."""
    renamed = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(renamed, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(base.columns)


def compare_and_set(base: DataFrame, fixes: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Replaces `column` where it equals the fix's ``old``; the report says fixed, mismatch or not_found per fix.
    fixes: key, old, new."""
    joined = base.join(fixes, key, "left")
    hit = F.col(column).eqNullSafe(F.col("old")) & F.col("new").isNotNull()
    done = joined.withColumn(column, F.when(hit, F.col("new")).otherwise(F.col(column))).select(base.columns)
    found = fixes.join(base.select(key, F.col(column).alias("now")).withColumn("there", F.lit(True)), key, "left")
    status = F.when(F.col("there").isNull(), "not_found").when(F.col("now").eqNullSafe(F.col("old")), "fixed").otherwise("mismatch")
    return done, found.select(key, status.alias("status"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, lon: str, lat: str, ring: str) -> DataFrame:
    """Pairs of a point and a polygon whose ring (array<struct<x, y>>) holds it, with the columns of both.

    Points at one place and polygons of one ring are tested once. ``candidates`` finds the near pairs in cells that are as deep as the places are
    dense, the exact test follows, and what holds is expanded to the rows; all steps are shared out by the number of pairs, so neither a dense place
    nor many copies end in one task.
    """
    other = lambda df, *used: F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in df.columns if c not in used])
    x, y = F.col(f"`{lon}`"), F.col(f"`{lat}`")
    a = Classes(points.where(x.isNotNull() & y.isNotNull()).select(other(points, lon, lat).alias("id"), F.struct(x.alias("x"), y.alias("y")).alias("value")), "id", "value")
    b = Classes(polygons.select(other(polygons, ring).alias("id"), F.col(f"`{ring}`").alias("value")), "id", "value")
    value = F.col("value")
    as_point = F.struct(F.lit("POINT").alias("kind"), F.array(F.array(F.array(F.struct(value["x"].cast("double").alias("x"), value["y"].cast("double").alias("y"))))).alias("parts"))
    as_polygon = F.struct(F.lit("POLYGON").alias("kind"), F.array(F.array(value)).alias("parts"))
    pairs = candidates(a.distinct.withColumn("geometry", as_point), b.distinct.withColumn("geometry", as_polygon), "rep", "rep").toDF("left_rep", "right_rep")
    one, two = a.distinct.select(F.col("rep").alias("left_rep"), value.alias("point")), b.distinct.select(F.col("rep").alias("right_rep"), value.alias("ring"))
    held = pairs.join(one, "left_rep").join(two, "right_rep").where(in_ring(F.col("point.x"), F.col("point.y"), F.col("ring")))
    flat = held.select("left_rep", "right_rep", F.col("point.x").alias("__x"), F.col("point.y").alias("__y"), F.col("ring").alias("__ring"))
    out = expanded_smaller_first(flat, a, b)
    side = lambda df, at, own: [own.get(c, F.col(f"{at}.`{c}`")).alias(c) for c in df.columns]
    return out.select(*side(points, "left_id", {lon: F.col("__x"), lat: F.col("__y")}), *side(polygons, "right_id", {ring: F.col("__ring")}))


def with_once(df: DataFrame, inputs: list[str], columns: dict[str, Column]) -> DataFrame:
    """df with columns that depend on the inputs alone, each computed once for every distinct row of inputs; nulls are values."""
    made = stored(df.select(*inputs).distinct().select(*inputs, *[c.alias(k) for k, c in columns.items()]), "once")
    two = made.select(*[F.col(c).alias(f"__{c}") for c in inputs], *columns)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in inputs])
    return df.join(two, same, "left").drop(*[f"__{c}" for c in inputs])


def within_band(left: DataFrame, right: DataFrame, key: str, width: float, left_value: str, right_value: str) -> DataFrame:
    """Equi-join on a key and |left - right| <= width, by bucketing the value: each left row meets three buckets."""
    bucket = lambda c: F.floor(F.col(c) / width)
    three = left.withColumn("__b", F.explode(F.array(bucket(left_value) - 1, bucket(left_value), bucket(left_value) + 1)))
    return three.join(right.withColumn("__b", bucket(right_value)), [key, "__b"]).where(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("__b")


def within_band(left: DataFrame, right: DataFrame, key: str, width: float, left_value: str, right_value: str) -> DataFrame:
    """Equi-join on a key and |left - right| <= width, by bucketing the value: each left row meets three buckets."""
    bucket = lambda c: F.floor(F.col(c) / width)
    three = left.withColumn("__b", F.explode(F.array(bucket(left_value) - 1, bucket(left_value), bucket(left_value) + 1)))
    return three.join(right.withColumn("__b", bucket(right_value)), [key, "__b"]).where(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("__b")


def band_totals(df: DataFrame, keys: list[str], value: str, width: float, measure: str) -> DataFrame:
    """(keys, n, total): the pairs of rows with equal keys and values at most `width` apart, and the sum of the (whole-number) measure over both
    rows of every pair. Each pair of different rows counts once; rows with a null, or a value that is not finite, have none.

    No pair is made. Rows are summed by value; in buckets a little wider than the band, running sums up to a row's value and up to the end of its band,
    which lies in the same bucket or the next, give what lies between. value + width is held with its rounding error, so its place is exact.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    v = F.col(value).cast("double")
    rows = df.where(F.abs(v) < float("inf")).dropna(subset=[*keys, measure]).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("c"), F.sum(F.col(measure).cast("decimal(20,0)")).alias("s"))
    b = F.floor(F.col("v") / (width * (1 + 2**-20)))
    end = F.col("v") + width
    back = end - F.col("v")
    error = (F.col("v") - (end - back)) + (width - back)
    place = lambda bucket, at, rest, item: F.struct(bucket.alias("b"), at.alias("at"), rest.alias("rest"), F.lit(item).alias("item"))
    listed = F.array(place(b, F.col("v"), F.lit(0.0), 1), place(b, end, error, 0), place(b + 1, end, error, 0))
    items = rows.select(*keys, "c", "s", F.explode(listed).alias("p")).select(*keys, "c", "s", "p.*")
    # an item comes before the end of a band at its place
    upto = Window.partitionBy(*keys, "b").orderBy("at", "rest", F.desc("item")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("item") == 1
    items = items.select(*keys, "c", "s", "item", F.sum(F.when(own, F.col("c")).otherwise(0)).over(upto).alias("pc"), F.sum(F.when(own, whole("s")).otherwise(0)).over(upto).alias("ps"))
    sign = F.when(own, -1).otherwise(1)
    alike = F.when(own, whole("c") * (F.col("c") - 1) / 2).otherwise(0)  # pairs of rows of one value
    n = F.sum((whole("c") * whole("pc") * sign + alike).cast("decimal(38,0)"))
    total = F.sum(((whole("s") * whole("pc") + whole("c") * whole("ps")) * sign + F.when(own, whole("s") * (F.col("c") - 1)).otherwise(0)).cast("decimal(38,0)"))
    return items.groupBy(*keys).agg(n.cast("bigint").alias("n"), total.alias("total"))


def same_ids(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """One row: ids only in the first, only in the second, in both."""
    a, b = one.select(key).distinct().withColumn("a", F.lit(1)), two.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
