"""Reproducible samples, quotas and splits: the order is a hash of id and seed, so the same data give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.sources.scratch import stored


def det_order(id_col: str | Column, seed: int | str = 42) -> Column:
    """A random-looking order that does not depend on partitions or engines."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(col.cast("string"), F.lit(f"|{seed}")))


def unit(id_col: str | Column, seed: int | str = 42) -> Column:
    """A number in [0, 1) from the same hash."""
    return F.conv(F.substring(det_order(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Rows of a group that one task may rank; larger groups are cut by the first digits of their hash.
LARGE = 1 << 17


def free_name(df: DataFrame, name: str) -> str:
    """The name, or that with underscores, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def _rank(keys: list[str], id_col: str, seed: int | str) -> Column:
    """The rank in the group's hash order, of groups that one task may rank."""
    return F.row_number().over(W.partitionBy(*_cols(keys)).orderBy(det_order(F.col(f"`{id_col}`"), seed), F.col(f"`{id_col}`")))


def _largest(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*_cols(keys)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def ranked(df: DataFrame, keys: list[str], id_col: str, seed: int | str, rank: str, size: str | None = None, quota: Column | int | None = None, most: int = LARGE, weight: str | None = None) -> DataFrame:
    """df with each row's rank in its group's hash order, from 1, and the group's size if it is named; with a `quota` (one
    value for a group) only the rows of that rank or less. Without keys the whole is one group. With a column of whole
    numbers as `weight` the rank is their sum up to and with the row, and the size their sum in the group.

    Where the largest group has more than ``most`` rows, all groups are cut by as many digits of the hash as bring a part below that. Rows are
    ranked within their part and the parts' sizes are added up, so a group that is a large part of the data is ranked by many tasks; parts
    that lie beyond the quota are not ranked at all, the quota's own part is cut at the row.
    """
    digits, largest = 0, _largest(df, keys)
    while largest > most << 4 * digits:
        digits += 1
    order = det_order(F.col(f"`{id_col}`"), seed)
    columns = [*_cols(df.columns), F.col(f"`{rank}`"), *([F.col(f"`{size}`")] if size else [])]
    running = lambda w: F.row_number().over(w) if weight is None else F.sum(f"`{weight}`").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = F.count("*") if weight is None else F.sum(f"`{weight}`")
    wanted = F.lit(True) if quota is None else F.col(f"`{rank}`") <= quota
    if not digits:
        group = W.partitionBy(*_cols(keys))
        out = df.withColumn(rank, _rank(keys, id_col, seed) if weight is None else running(group.orderBy(order, F.col(f"`{id_col}`"))))
        return (out.withColumn(size, whole.over(group)) if size else out).select(columns).where(wanted)
    part, before, total, limit = (free_name(df, x) for x in ("hash part", "rows before", "rows in all", "quota of group"))
    placed = df.withColumn(part, F.substring(order, 1, digits))
    on = [*keys, part]
    quota = F.lit(quota) if isinstance(quota, int) else quota
    sizes = placed.groupBy(*_cols(on)).agg(whole.alias(total), F.max(F.lit(1 << 62) if quota is None else quota).alias(limit))
    group, n = W.partitionBy(*_cols(keys)), F.col(f"`{total}`")
    sums = sizes.select(*_cols(on), limit, (F.sum(n).over(group.orderBy(F.col(f"`{part}`"))) - n).alias(before), F.sum(n).over(group).alias(total))
    sums = sums.where(F.col(f"`{before}`") < F.col(f"`{limit}`"))
    sums = sums.select(*[F.col(f"`{c}`").alias(f"{part} {i}") for i, c in enumerate(on)], before, F.col(f"`{total}`").alias(size or total))
    match = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{part} {i}`")) for i, c in enumerate(on)]
    within = W.partitionBy(*_cols(on)).orderBy(order, F.col(f"`{id_col}`"))
    return placed.join(sums, match).withColumn(rank, F.col(f"`{before}`") + running(within)).select(columns).where(wanted)


def ranked_by(df: DataFrame, keys: list[str], order: list[Column], rank: str, size: str | None = None, most: int = LARGE) -> DataFrame:
    """df with each row's rank in its group by the given order, from 1, and the group's size if it is named.

    Where a group has more than ``most`` rows, df is range-partitioned by keys and order and stored, so that a group spans
    many tasks; rows are ranked within a task's part of the group, and the parts' sizes are added up.
    """
    group, columns = W.partitionBy(*_cols(keys)), [*_cols(df.columns), F.col(f"`{rank}`"), *([F.col(f"`{size}`")] if size else [])]
    if _largest(df, keys) <= most:
        out = df.withColumn(rank, F.row_number().over(group.orderBy(*order)))
        return (out.withColumn(size, F.count("*").over(group)) if size else out).select(columns)
    part, before, total = (free_name(df, x) for x in ("range part", "rows before", "rows in all"))
    ranges = -(-df.count() // most)
    placed = stored(df.repartitionByRange(ranges, *_cols(keys), *order).withColumn(part, F.spark_partition_id()), "ranges")
    on, n = [*keys, part], F.col(f"`{total}`")
    sizes = placed.groupBy(*_cols(on)).agg(F.count("*").alias(total))
    sums = sizes.select(*[F.col(f"`{c}`").alias(f"{part} {i}") for i, c in enumerate(on)], (F.sum(n).over(group.orderBy(F.col(f"`{part}`"))) - n).alias(before), F.sum(n).over(group).alias(size or total))
    match = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{part} {i}`")) for i, c in enumerate(on)]
    within = W.partitionBy(*_cols(on)).orderBy(*order)
    return placed.join(sums, match).withColumn(rank, F.col(f"`{before}`") + F.row_number().over(within)).select(columns)


def at_most(df: DataFrame, keys: list[str], n: int, id_col: str, seed: int | str = 42) -> DataFrame:
    """At most n rows of each group."""
    rank = free_name(df, "rank")
    return ranked(df, keys, id_col, seed, rank, quota=n).drop(rank)


def quota_sample(df: DataFrame, keys: list[str], quotas: DataFrame, id_col: str, seed: int | str = 42) -> DataFrame:
    """At most quota rows of each group; groups without a quota give none. quotas: keys and a column quota."""
    quota = free_name(df, "quota")
    rows = df.join(quotas.select(*_cols(keys), F.col("quota").alias(quota)), keys)
    rank = free_name(rows, "rank")
    return ranked(rows, keys, id_col, seed, rank, quota=F.col(f"`{quota}`")).select(_cols(df.columns))


def quota_with_backfill(df: DataFrame, keys: list[str], quotas: DataFrame, total: int, id_col: str, seed: int | str = 42) -> DataFrame:
    """A quota sample, filled up to `total` from the rows it left out; both parts in hash order. The fill is itself a quota, found by
    rank, so no task holds all rows."""
    chosen = quota_sample(df, keys, quotas, id_col, seed)
    rank, have = free_name(df, "rank"), chosen.count()
    if have >= total:
        return ranked(chosen, [], id_col, seed, rank, quota=total).drop(rank)
    rest = df.join(chosen.select(F.col(f"`{id_col}`")), id_col, "left_anti").select(_cols(df.columns))
    return chosen.unionByName(ranked(rest, [], id_col, seed, rank, quota=total - have).drop(rank))


def bernoulli(df: DataFrame, shares: dict[str, float], id_col: str, out: str, seed: int | str = 42) -> DataFrame:
    """A label per row by independent draws; the last label takes what remains."""
    u, names, upto = unit(id_col, seed), list(shares), 0.0
    label = F.lit(names[-1])
    bounds = []
    for name in names[:-1]:
        upto += shares[name]
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        label = F.when(u < bound, name).otherwise(label)
    return df.withColumn(out, label)


def ratio_split(df: DataFrame, keys: list[str], ratios: tuple[float, float] = (0.8, 0.1), id_col: str = "id", seed: int | str = 42, out: str = "split") -> DataFrame:
    """Exact split within each group: floors of the first two ratios, the rest is test. With no keys the whole is one group. The
    column `out` must be new to df."""
    rank, size = free_name(df, "rank"), free_name(df, "size")
    n, r = F.col(f"`{size}`"), F.col(f"`{rank}`")
    train, dev = F.floor(n * ratios[0] + 1e-9), F.floor(n * ratios[1] + 1e-9)
    label = F.when(r <= train, "train").when(r <= train + dev, "dev").otherwise("test")
    return ranked(df, keys, id_col, seed, rank, size).select(*_cols(df.columns), label.alias(_new(df, out)))


def _new(df: DataFrame, name: str) -> str:
    if free_name(df, name) != name:
        raise ValueError(f"there is a column {name} already; give another name")
    return name


def hash_split(df: DataFrame, ratios: dict[str, float], id_col: str, seed: int | str = 42) -> DataFrame:
    """Approximate split by hash, without any shuffle; all rows of an id fall together."""
    return bernoulli(df, ratios, id_col, "split", seed)


def merge_new(base: DataFrame, extra: DataFrame, id_col: str) -> DataFrame:
    """All of base, and the rows of extra whose id base does not have."""
    return base.unionByName(extra.join(base.select(id_col), id_col, "left_anti").select(base.columns))


def overlap(base: DataFrame, extra: DataFrame, id_col: str) -> DataFrame:
    """One row about a merge by ``merge_new``: rows of base, rows of extra, those whose id base has, those that are added, and the rows in all."""
    known = extra.join(base.select(id_col).distinct().withColumn("known", F.lit(1)), id_col, "left")
    counts = known.agg(F.count("*").alias("extra"), F.count("known").alias("shared")).crossJoin(base.agg(F.count("*").alias("base")))
    added = F.col("extra") - F.col("shared")
    return counts.select("base", "extra", "shared", added.alias("added"), (F.col("base") + added).alias("merged"))


def topology_quota(
    df: DataFrame, quotas: dict[tuple[str, str], int], subtypes: list[str], total: int, relation: str = "relation", level: str = "difficulty", subtype: str = "subtype", id_col: str = "id", seed: int | str = 42
) -> DataFrame:
    """A quota for each relation and level, of which each topological subtype has an equal part (rounded down); then rows that were left out, up to
    `total`, and no more than that. Null keys belong to no quota."""
    small = [(r, d, s, n // len(subtypes)) for (r, d), n in quotas.items() if r == "topological" for s in subtypes] + [(r, d, "-", n) for (r, d), n in quotas.items() if r != "topological"]
    cell = free_name(df, "cell")
    keyed = df.withColumn(cell, F.concat_ws("|", relation, level, F.when(F.col(relation) == "topological", F.col(subtype)).otherwise("-")))
    table = df.sparkSession.createDataFrame([("|".join(x[:3]), x[3]) for x in small], f"`{cell}` string, quota int")
    return quota_with_backfill(keyed, [cell], table, total, id_col, seed).drop(cell)


def supplement(candidates: DataFrame, taken: DataFrame, id_col: str, pair_col: str, key: str, deficits: DataFrame, seed: int | str = 42) -> DataFrame:
    """Rows that fill each group's deficit without an id or pair that is taken. deficits: key and a column quota."""
    free = candidates.join(taken.select(pair_col).distinct(), pair_col, "left_anti").join(taken.select(id_col), id_col, "left_anti").select(candidates.columns)
    return quota_sample(free, [key], deficits, id_col, seed)


def fixed_split(df: DataFrame, keys: list[str], sizes: tuple[int, int, int], id_col: str = "id", seed: int | str = 42, out: str = "split") -> DataFrame:
    """Split of fixed sizes within each group: each part gets its share of the group, at least one row; if that is more than
    the group has, the first two shrink in proportion and the third takes the rest. Rows beyond the parts get null. The column `out`
    must be new to df."""
    rank, size, total = free_name(df, "rank"), free_name(df, "size"), sum(sizes)
    n, r = F.col(f"`{size}`"), F.col(f"`{rank}`")
    a, b, c = (F.greatest(F.lit(1), F.floor(n * (s / total) + 1e-9)) for s in sizes)
    over = (a + b + c) > n
    less = lambda x: F.greatest(F.lit(1), F.floor(x * n / (a + b + c) + 1e-9))
    train, dev = F.when(over, less(a)).otherwise(a), F.when(over, less(b)).otherwise(b)
    test = F.when(over, n - train - dev).otherwise(c)
    label = F.when(r <= train, "train").when(r <= train + dev, "dev").when(r <= train + dev + test, "test")
    return ranked(df, keys, id_col, seed, rank, size).select(*_cols(df.columns), label.alias(_new(df, out)))


def level_quotas(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole quotas by level; the last level takes what remains."""
    names = list(shares)
    quotas = {k: int(total * shares[k]) for k in names[:-1]}
    return quotas | {names[-1]: total - sum(quotas.values())}


def by_level(df: DataFrame, level: str, total: int, shares: dict[str, float], id_col: str = "id", seed: int | str = 42, rank: str = "rank") -> DataFrame:
    """At most each level's quota of rows, with their rank; all of a level that has fewer; other levels give none. The column
    `rank` must be new to df."""
    quota = F.lit(0)
    for name, n in level_quotas(total, shares).items():
        quota = F.when(F.col(f"`{level}`") == name, n).otherwise(quota)
    return ranked(df, [level], id_col, seed, _new(df, rank), quota=quota)


def levels_by_rank(
    df: DataFrame, keys: list[str], bands: list[tuple[float, str, float, float]], id_col: str = "id", seed: int | str = 42, level: str = "level", score: str = "score"
) -> DataFrame:
    """A level by place in the group's hash order, and a score, to one decimal, drawn evenly from the level's range; bands: (share of
    the group, level, least score, greatest score). A band has the floor of its share of the rows, the last all that remain. The columns
    `level` and `score` must be new to df."""
    rank, size = free_name(df, "rank"), free_name(df, "size")
    n, r, u = F.col(f"`{size}`"), F.col(f"`{rank}`"), unit(F.col(f"`{id_col}`"), f"{seed} score")
    tops, upto = [], F.lit(0)
    for share, *_ in bands[:-1]:
        upto = upto + F.floor(n * share + 1e-9)
        tops.append(upto)
    named = lambda pick: reduce(lambda tail, k: F.when(r <= tops[k], pick(bands[k])).otherwise(tail), reversed(range(len(tops))), pick(bands[-1]))
    labels = [named(lambda b: F.lit(b[1])).alias(_new(df, level)), named(lambda b: F.round(b[2] + u * (b[3] - b[2]), 1)).alias(_new(df, score))]
    return ranked(df, keys, id_col, seed, rank, size).select(*_cols(df.columns), *labels)
