"""Distribution profiles: shares, distances between distributions, circular and moment statistics, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shares(df: DataFrame, key: str) -> DataFrame:
    """key, n, share."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def against_target(df: DataFrame, key: str, target: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """key, n, share, target, deviation, ok: every key of the data or the target."""
    spark = df.sparkSession
    goals = spark.createDataFrame(list(target.items()), f"{key} string, target double")
    both = shares(df, key).join(goals, key, "full_outer").na.fill({"n": 0, "share": 0.0, "target": 0.0})
    gap = F.abs(F.col("share") - F.col("target"))
    return both.select(key, "n", "share", "target", gap.alias("deviation"), (gap <= tolerance).alias("ok"))


def total_variation(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Half the sum of absolute differences of the shares of two frames' keys: one row, tvd."""
    a, b = shares(one, key).select(key, F.col("share").alias("p")), shares(two, key).select(key, F.col("share").alias("q"))
    return a.join(b, key, "full_outer").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tvd"))


def uniform_distance(df: DataFrame, key: str, size: int) -> DataFrame:
    """Total variation distance from the uniform distribution over `size` keys, of which those absent count."""
    s = shares(df, key)
    return s.agg(((F.sum(F.abs(F.col("share") - 1.0 / size)) + (size - F.count("*")) / F.lit(float(size))) / 2).alias("tvd"))


def kolmogorov_smirnov(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Greatest difference of the cumulative shares over the sorted keys: one row, ks. The window runs over the few keys."""
    a, b = shares(one, key).select(key, F.col("share").alias("p")), shares(two, key).select(key, F.col("share").alias("q"))
    both = a.join(b, key, "full_outer").na.fill(0.0, ["p", "q"])
    up = W.orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.select(F.abs(F.sum("p").over(up) - F.sum("q").over(up)).alias("gap")).agg(F.max("gap").alias("ks"))


def variation(df: DataFrame, key: str) -> DataFrame:
    """Coefficient of variation (sample deviation over mean) of the frequencies of a key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg((F.stddev_samp("n") / F.avg("n")).alias("cv"))


def circular(degrees: Column) -> list[Column]:
    """Aggregates of angles: concentration r, and the mean angle where r > 0.3 (else null)."""
    c, s = F.avg(F.cos(F.radians(degrees))), F.avg(F.sin(F.radians(degrees)))
    r = F.sqrt(c * c + s * s)
    return [r.alias("r"), F.when(r > 0.3, F.pmod(F.degrees(F.atan2(s, c)) + 360.0, F.lit(360.0))).alias("mean_angle")]


def moments(value: Column) -> list[Column]:
    """Population statistics of a number."""
    return [
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.median(value).alias("median"),
        F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"),
    ]


def band(value: Column, edges: list[float]) -> Column:
    """Label of the half-open band [lo, hi) that holds the value; the last is open above."""
    names = [f"{lo:g}-{hi:g}" for lo, hi in zip(edges, edges[1:], strict=False)] + [f"{edges[-1]:g}+"]
    out = F.lit(names[-1])
    for hi, name in zip(reversed(edges[1:]), reversed(names[:-1]), strict=True):
        out = F.when(value < hi, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def concentration(df: DataFrame, key: str, marks: tuple[float, ...] = (0.5, 0.8, 0.9)) -> DataFrame:
    """How concentrated a key's values are: n_values, unique_ratio, top1_share, top5_share, and for each mark the number
    of most frequent values that cover it.

    Values are reduced to how many of them have each frequency before they are ordered, so the window
    runs over distinct frequencies (about the square root of the rows), not over values.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    levels = counts.groupBy("n").agg(F.count("*").alias("values"))
    down = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = levels.select("n", "values", F.sum(F.col("n") * F.col("values")).over(down).alias("mass"), F.sum("values").over(down).alias("rank"), F.sum(F.col("n") * F.col("values")).over(W.partitionBy()).alias("total"))
    before, mass_before = F.col("rank") - F.col("values"), F.col("mass") - F.col("n") * F.col("values")

    def cover(share: float) -> Column:
        need = F.ceil((F.col("total") * share - mass_before) / F.col("n") - 1e-9)
        return F.min(F.when(F.col("mass") >= F.col("total") * share - 1e-9, before + F.greatest(need, F.lit(1))))

    def top(k: int) -> Column:
        return F.sum(F.col("n") * F.greatest(F.least(F.col("values"), k - before), F.lit(0))) / F.max("total")

    return run.agg(
        F.max("rank").alias("n_values"), (F.max("rank") / F.max("total")).alias("unique_ratio"), top(1).alias("top1_share"), top(5).alias("top5_share"),
        *[cover(m).cast("long").alias(f"cover_{int(m * 100)}") for m in marks],
    )
