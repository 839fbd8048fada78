"""Ranks, quotas and splits of large groups: the same rows whether a group is ranked whole or in parts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.operators import sampling, split


def rows(spark, n=3000):
    """One group with most of the rows, a null group, and columns with the names that the operators use."""
    data = [(i, "hot" if i % 10 else (None if i % 20 else f"g{i % 7}"), i % 3, "x", 0.5) for i in range(n)]
    return spark.createDataFrame(data, "id long, g string, rank int, split string, share double")


def in_order(data, seed=42):
    return sorted(data, key=lambda r: (hashlib.md5(f"{r.id}|{seed}".encode()).hexdigest(), r.id))


@pytest.mark.parametrize("most", [1 << 17, 300, 7])
def test_ranks_do_not_depend_on_the_parts(spark, most):
    df = rows(spark)
    groups = {}
    for r in in_order(df.collect()):
        groups.setdefault(r.g, []).append(r)
    want = {r.id: (k, len(v)) for v in groups.values() for k, r in enumerate(v, 1)}
    got = sampling.ranked(df, ["g"], "id", 42, "r", "n", most=most).collect()
    assert {x.id: (x.r, x.n) for x in got} == want and got[0].asDict().keys() == {*df.columns, "r", "n"}
    for quota in (1, 130, 5000):
        got = sampling.ranked(df, ["g"], "id", 42, "r", quota=quota, most=most).collect()
        assert {x.id: x.r for x in got} == {i: k for i, (k, _) in want.items() if k <= quota}
    by = F.when(F.col("g") == "hot", 1000).otherwise(2)
    got = sampling.ranked(df, ["g"], "id", 42, "r", quota=by, most=most).collect()
    assert {x.id for x in got} == {r.id for g, v in groups.items() for r in v[: 1000 if g == "hot" else 2]}
    whole = sampling.ranked(df, [], "id", 42, "r", "n", most=most).collect()
    assert [x.id for x in sorted(whole, key=lambda x: x.r)] == [r.id for r in in_order(df.collect())]


@pytest.mark.parametrize("most", [1 << 17, 200])
def test_ranks_by_an_order(spark, most):
    df = rows(spark).repartition(5)
    got = sampling.ranked_by(df, ["g"], [F.desc("rank"), F.col("id")], "r", "n", most=most).collect()
    groups = {}
    for r in sorted(df.collect(), key=lambda r: (-r["rank"], r.id)):
        groups.setdefault(r.g, []).append(r.id)
    assert {x.id: (x.r, x.n) for x in got} == {i: (k, len(v)) for v in groups.values() for k, i in enumerate(v, 1)}


@pytest.mark.parametrize("most", [1 << 17, 50])
def test_quota_with_backfill_and_levels(spark, monkeypatch, most):
    monkeypatch.setattr(sampling.ranked, "__defaults__", (None, None, most, None))
    df = rows(spark, 900)
    quotas = spark.createDataFrame([("hot", 100), ("g0", 3)], "g string, quota int")
    groups = {}
    for r in in_order(df.collect()):
        groups.setdefault(r.g, []).append(r)
    chosen = [r.id for r in groups["hot"][:100]] + [r.id for r in groups["g0"][:3]]
    rest = [r.id for r in in_order(df.collect()) if r.id not in set(chosen)]
    got = sampling.quota_with_backfill(df, ["g"], quotas, 150, "id")
    assert got.columns == df.columns and {r.id for r in got.collect()} == set(chosen + rest[: 150 - len(chosen)])
    few = {r.id for r in sampling.quota_with_backfill(df, ["g"], quotas, 40, "id").collect()}
    assert len(few) == 40 and few == set([r.id for r in in_order(df.collect()) if r.id in set(chosen)][:40])

    bands = [(0.3, "easy", 1.0, 2.0), (0.5, "medium", 2.0, 3.5), (0.2, "hard", 3.5, 5.0)]
    got = sampling.levels_by_rank(df, ["g"], bands).collect()
    for g, v in groups.items():
        n = {name: sum(x.level == name for x in got if x.g == g) for name in ("easy", "medium", "hard")}
        assert (n["easy"], n["medium"]) == (int(len(v) * 0.3 + 1e-9), int(len(v) * 0.5 + 1e-9)) and sum(n.values()) == len(v)
    assert all(x.score == round(x.score, 1) for x in got)
    nine = sampling.levels_by_rank(df.where("g = 'hot'").limit(9), ["g"], bands).groupBy("level").count().collect()
    assert {r.level: r["count"] for r in nine} == {"easy": 2, "medium": 4, "hard": 3}


def test_columns_of_the_input_are_not_overwritten(spark):
    df = rows(spark, 100)
    before = {r.id: r for r in df.collect()}
    for out in (sampling.at_most(df, ["g"], 5, "id"), sampling.levels_by_rank(df, ["g"], [(1.0, "a", 0.0, 1.0)]).select(df.columns), split.trim(df, spark.createDataFrame([("x", 30)], "split string, target int"), "id")):
        assert out.columns == df.columns and all(before[r.id] == r for r in out.collect())
    for call in (lambda: sampling.ratio_split(df, []), lambda: sampling.fixed_split(df, [], (8, 1, 1)), lambda: sampling.by_level(df, "g", 5, {"hot": 1.0})):
        with pytest.raises(ValueError, match="column"):
            call()
    assert sampling.ratio_split(df, [], out="part").columns == [*df.columns, "part"]


@pytest.mark.parametrize(("cells", "most"), [(10_000, 1 << 17), (20, 16)])
def test_pair_exclusive_split_meets_the_targets_over_all_cells(spark, monkeypatch, cells, most):
    monkeypatch.setattr(sampling.ranked, "__defaults__", (None, None, most, None))
    df = spark.createDataFrame([(i, f"p{i % 400 if i % 3 else i % 7}", f"l{i % 4}") for i in range(4000)], "id long, pair string, layer string")
    for targets in ({"train": 0.8, "dev": 0.1, "test": 0.1}, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}):
        out = split.pair_exclusive_split(df, "pair", "layer", "id", targets, cell_pairs=cells)
        assert out.columns == [*df.columns, "split"] and out.count() == df.count() and split.leakage(out, "pair").count() == 0
        largest = max(r["count"] for r in df.groupBy("pair").count().collect())
        held = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        assert all(abs(held.get(s, 0) - share * 4000) <= largest for s, share in targets.items()), held
    many = spark.createDataFrame([(i, f"p{i // 3}", "l") for i in range(3000)], "id long, pair string, layer string")
    held = {r["split"]: r["count"] for r in split.pair_exclusive_split(many, "pair", "layer", "id", cell_pairs=3).groupBy("split").count().collect()}
    assert all(abs(held[s] - share * 3000) <= 3 for s, share in (("train", 0.8), ("dev", 0.1), ("test", 0.1))), held
