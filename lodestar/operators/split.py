"""Splits that keep all rows of an entity pair together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.profile import shares
from lodestar.operators.sampling import quota_sample, ranked, ranked_by, unit
from lodestar.sources.scratch import stored


def ranked_pairs(df: DataFrame, relation: str, pair: str, ratios: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """(relation, pair, n, split): per relation the pairs by falling size; the first share of pairs is train, the next dev, the rest
    test. n is the pair's number of rows; rows without a pair are left out."""
    pairs = df.where(F.col(f"`{pair}`").isNotNull()).groupBy(relation, pair).agg(F.count("*").alias("n"))
    ranked = ranked_by(pairs, [relation], [F.desc("n"), F.col(f"`{pair}`")], "rank of pair", "pairs in all")
    total, r = F.col("`pairs in all`"), F.col("`rank of pair`")
    train, dev = F.floor(total * ratios[0] + 1e-9), F.floor(total * ratios[1] + 1e-9)
    return ranked.select(relation, pair, "n", F.when(r <= train, "train").when(r <= train + dev, "dev").otherwise("test").alias("split"))


def pair_split_by_rank(df: DataFrame, relation: str, pair: str, ratios: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """Rows with the split of their pair (see ranked_pairs). A pair may fall differently under two relations (see leakage)."""
    return df.join(ranked_pairs(df, relation, pair, ratios).drop("n"), [relation, pair])


def pair_exclusive_split(
    df: DataFrame, pair: str, layer: str, id_col: str = "id", targets: dict[str, float] | None = None, cell_pairs: int = 20_000, seed: int = 42
) -> DataFrame:
    """Leakage-free split by greedy filling: groups of one pair go whole to the split that is furthest below its target;
    near ties (0.05) go where the split's layer distribution comes closest to that of the cell.

    Pairs are dealt by hash to cells of about `cell_pairs`, however many there are; each cell is filled on its own in one
    grouped task, so the greedy state never spans more than one cell. What the cells' splits miss of the targets is then
    levelled over the whole table (see ``levelled``): each split's rows with a pair differ from its target by no more than the largest pair has.
    Rows without a pair follow a hash of their id.
    """
    import pandas as pd

    targets = targets or {"train": 0.8, "dev": 0.1, "test": 0.1}
    names = list(targets)
    summary = df.where(F.col(pair).isNotNull()).groupBy(pair, layer).agg(F.count("*").alias("n"))
    cells = max(1, -(-summary.select(pair).distinct().count() // cell_pairs))
    cell = summary.withColumn("cell", F.pmod(F.xxhash64(pair), F.lit(cells)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        import numpy as np

        table = frame.pivot_table(index=pair, columns=layer, values="n", aggfunc="sum", fill_value=0)
        counts, keys = table.to_numpy(float), table.index.tolist()
        whole = counts.sum(axis=0)
        share, goal = whole / whole.sum(), np.array([targets[s] for s in names]) * whole.sum()
        held, out = np.zeros((len(names), len(whole))), []
        for i in sorted(range(len(keys)), key=lambda i: hashlib.md5(f"{keys[i]}|{seed}".encode()).hexdigest()):
            gap = 1 - held.sum(axis=1) / goal
            near = np.flatnonzero(gap >= gap.max() - 0.05)
            after = held[near] + counts[i]
            drift = np.abs(after / after.sum(axis=1, keepdims=True) - share).sum(axis=1)
            best = near[int(drift.argmin())]
            held[best] += counts[i]
            out.append((keys[i], names[best]))
        return pd.DataFrame(out, columns=[pair, "split"])

    kind = df.schema[pair].dataType.simpleString()
    proposed = cell.groupBy("cell").applyInPandas(fill, f"`{pair}` {kind}, split string")
    sizes = summary.groupBy(pair).agg(F.sum("n").alias("n"))
    assigned = levelled(stored(proposed.join(sizes, pair), "pairs"), pair, targets, seed).drop("n")
    u, upto, label = unit(id_col, seed), 0.0, F.lit(names[-1])
    for name in reversed(names[:-1]):
        upto = sum(targets[x] for x in names[: names.index(name) + 1])
        label = F.when(u < upto, name).otherwise(label)
    return df.join(assigned, pair, "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("split", label).alias("split"))


def levelled(assigned: DataFrame, pair: str, targets: dict[str, float], seed: int = 42) -> DataFrame:
    """(pair, split, n) with whole pairs moved from splits over their target to those below it.

    The splits' sums, a row each, say how many rows go from which split to which. In each split with too many, pairs are added up in hash
    order (by many tasks, see ``ranked``), and a pair whose middle falls in the run of rows for another split goes there. So each run ends within half a
    pair of where it should, and no split is off by more than the largest pair.
    """
    held = {r["split"]: r["n"] for r in assigned.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    whole, names = sum(held.values()), list(targets)
    goal = {s: targets[s] * whole for s in names}
    short = {s: goal[s] - held.get(s, 0) for s in names if goal[s] > held.get(s, 0)}
    parts = [assigned.where(~F.col("split").isin([s for s in names if held.get(s, 0) > goal[s]]))]
    for s in names:
        much, runs = held.get(s, 0) - goal[s], []
        if much <= 0:
            continue
        for t in short:
            share = min(much, short[t])
            if share > 0:
                runs.append((t, (runs[-1][1] if runs else 0.0) + share))
                much, short[t] = much - share, short[t] - share
        summed = ranked(assigned.where(F.col("split") == s), [], pair, seed, "rows up to", weight="n")
        middle = F.col("`rows up to`") - F.col("n") / 2
        label = reduce(lambda tail, run: F.when(middle < run[1], run[0]).otherwise(tail), reversed(runs), F.lit(s))
        parts.append(summed.select(F.col(f"`{pair}`"), label.alias("split"), "n"))
    return reduce(DataFrame.unionByName, [p.select(F.col(f"`{pair}`"), "split", "n") for p in parts])


def leakage(df: DataFrame, pair: str) -> DataFrame:
    """Pairs that occur in more than one split: pair, splits."""
    return df.where(F.col(pair).isNotNull()).groupBy(pair).agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n")).where("n > 1").drop("n")


def trim(df: DataFrame, targets: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Each split cut to its target at random; splits without a target are dropped. targets: split and a column target."""
    return quota_sample(df, ["split"], targets.withColumnRenamed("target", "quota"), id_col, seed)


def split_drift(df: DataFrame, key: str) -> DataFrame:
    """Total variation distance of each split's key distribution from the whole: split, n, tvd."""
    whole = shares(df, key).select(key, F.col("share").alias("q"))
    counts = df.groupBy("split", key).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("split").agg(F.sum("n").alias("total"))
    grid = sizes.crossJoin(whole)  # a row for each split and key
    both = grid.join(counts, ["split", key], "left").na.fill(0, ["n"])
    return both.groupBy("split").agg(F.max("total").alias("n"), (F.sum(F.abs(F.col("n") / F.col("total") - F.col("q"))) / 2).alias("tvd"))


def layer_of(relation: str = "relation", difficulty: str = "difficulty", subtype: str = "subtype") -> Column:
    """The layer of a record: relation, difficulty and, of topological ones, the subtype."""
    part = F.when(F.col(relation) == "topological", F.coalesce(F.lower(F.trim(subtype)), F.lit("none")))
    return F.concat_ws("|", F.coalesce(relation, F.lit("none")), difficulty, part)


def acceptance(df: DataFrame, layer: str, targets: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """(split, n, ratio, ratio_ok, tvd, tvd_ok): each split's share of the rows against its target, and its layers against those of the whole."""
    goals = df.sparkSession.createDataFrame(list(targets.items()), "split string, target double")
    drift = split_drift(df, layer).join(goals, "split")
    whole = df.agg(F.count("*").alias("rows"))
    ratio = F.col("n") / F.col("rows")
    out = drift.crossJoin(whole).select("split", "n", ratio.alias("ratio"), (F.abs(ratio - F.col("target")) < tolerance).alias("ratio_ok"), "tvd")
    return out.withColumn("tvd_ok", F.col("tvd") < tolerance)
