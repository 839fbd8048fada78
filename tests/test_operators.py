"""Operators that SQL cannot state, readers, writers and streams."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.operators import chat, evaluate, joins, profile, split
from lodestar.sources import readers, writers
from lodestar.streaming import adapters


def test_pair_exclusive_split_has_no_leak_and_meets_targets(spark):
    df = spark.range(4000).select("id", (F.col("id") % 611).cast("string").alias("pair"), (F.col("id") % 3).cast("string").alias("layer"))
    df = df.withColumn("pair", F.when(F.col("id") % 50 > 0, F.col("pair")))
    out = split.pair_exclusive_split(df, "pair", "layer", cell_pairs=200)
    assert split.leakage(out, "pair").count() == 0
    n = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) == 4000 and abs(n["train"] / 4000 - 0.8) < 0.05


def test_concentration_counts_values(spark):
    df = spark.createDataFrame([(c,) for c in "aaaaabbbccd"], "x string")
    r = profile.concentration(df, "x").first()
    assert (r.n_values, r.cover_50, r.cover_80, r.cover_90) == (4, 2, 3, 3)
    assert r.top1_share == pytest.approx(5 / 11)


def test_compare_and_set(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    fixes = spark.createDataFrame([(1, "a", "z"), (2, "x", "y"), (3, "q", "r")], "id int, old string, new string")
    done, report = joins.compare_and_set(base, fixes, "id", "v")
    assert sorted(map(tuple, done.collect())) == [(1, "z"), (2, "b")]
    assert {r.id: r.status for r in report.collect()} == {1: "fixed", 2: "mismatch", 3: "not_found"}


def test_readers_and_writers(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"id": "a", "question": null, "score": 1}\n\n{bad\n{"id": "b", "question": "q"}\n', encoding="utf-8")
    kept = readers.jsonl(spark, str(path), "id string, question string", on_bad="keep")
    assert sorted((r.id or "", r._bad) for r in kept.collect()) == [("", True), ("a", False), ("b", False)]
    assert readers.jsonl(spark, str(path), "id string", on_bad="drop").where("id is not null").count() == 2
    states = readers.key_states(kept.where("not _bad"), ["question", "score"])
    assert {r.id: (r.state_question, r.state_score) for r in states.collect()} == {"a": ("null", "bigint"), "b": ("string", "missing")}
    doc = tmp_path / "d.json"
    doc.write_text('{"data": [{"id": "x"}, {"id": "y"}]}', encoding="utf-8")
    assert sorted(r.id for r in readers.json_documents(spark, str(doc), "id string").collect()) == ["x", "y"]
    out = str(tmp_path / "p")
    df = spark.createDataFrame([(1,), (2,)], "id int")
    writers.append_new(df, out, "id")
    writers.append_new(df.union(spark.createDataFrame([(3,)], "id int")), out, "id")
    assert spark.read.parquet(out).count() == 3
    assert writers.markdown(df).startswith("| id |")


def test_chat(spark):
    df = spark.createDataFrame([("i", "x", "o"), ("i", "", "o")], "instruction string, input string, output string")
    got = [r.messages[1].content for r in chat.from_instructions(df, "s").collect()]
    assert got == ["i\nx", "i"]


def test_judge_reply(spark):
    df = spark.createDataFrame([('ok {"accuracy": 5, "clarity": 2}',), ("accuracy：4",), ("",)], "t string").select(evaluate.judged(F.col("t")).alias("j"))
    assert [tuple(r.j) for r in df.collect()] == [(5, 3, 2), (4, 3, 3), (3, 3, 3)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:05:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'b'").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string").parquet(src)
    for i, df in enumerate((adapters.tumbling(stream, "ts", "k"), adapters.sliding(stream, "ts", "k"), adapters.sessions(stream, "ts", "k"))):
        q = df.writeStream.outputMode("complete" if i < 2 else "append").format("memory").queryName(f"s{i}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.k, r.n) for r in spark.table("s0").collect()} == {("a", 2), ("b", 1)}
    assert spark.table("s1").count() >= 8


def test_band_totals_are_those_of_all_pairs(spark):
    # many rows of one value, values exactly `width` apart and just beyond, below zero, none and not finite
    values = [0.0, 0.5, 0.5, 1.0, 1.0 + 2**-52, -0.25, 0.25, 31.9, 32.4, 32.400000000000006, 18.07, 18.57, None, float("nan"), float("inf")] + [(i * 53 % 360) / 100 for i in range(150)] + [7.0] * 20
    rows = [("ab"[i % 2] if i % 31 else None, v, i + 10**9) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double, id long").repartition(3)
    for width in (0.5, 0.3):
        want = {}
        for i, (k, v, one) in enumerate(rows):
            for l, u, two in rows[:i]:
                if k and k == l and v is not None and u is not None and abs(v - u) <= width:
                    n, total = want.get(k, (0, 0))
                    want[k] = n + 1, total + one + two
        got = {r.k: (r.n, int(r.total)) for r in joins.band_totals(df, ["k"], "v", width, "id").collect()}
        assert got == want


def test_points_in_polygons_of_many_copies_and_at_dense_places(spark):
    box = lambda a, b, c, d: geo.box_ring(*map(F.lit, (a, b, c, d)))
    boxes = [(0.0, 0.0, 2.5, 1.5), (1.0, 1.0, 3.5, 2.5), (100.0, 50.0, 102.5, 51.5)]
    polygons = reduce(DataFrame.union, [spark.range(300).select((F.col("id") + 1000 * i).alias("box"), box(*b).alias("ring")) for i, b in enumerate(boxes)])
    at = [(1.2, 1.2), (0.1, 0.1), (101.0, 50.5), (50.0, 50.0)]
    pick = lambda k: F.get(F.array(*[F.lit(p[k]) for p in at]), (F.col("id") % 4).cast("int"))
    points = spark.range(1200).select(F.when(F.col("id") > 3, F.col("id")).alias("id"), pick(0).alias("lon"), pick(1).alias("lat")).union(spark.createDataFrame([(5000, None, 1.0)], "id long, lon double, lat double"))
    found = joins.points_in_polygons(points, polygons, "lon", "lat", "ring")
    assert found.columns == ["id", "lon", "lat", "box", "ring"]
    got = {(r.lon, r.b): (r.n, r.known) for r in found.groupBy("lon", F.floor(F.col("box") / 1000).alias("b")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("known")).collect()}
    assert got == {k: (300 * 300, 299) for k in ((1.2, 0), (1.2, 1), (0.1, 0), (101.0, 2))}
    # more tasks than the few bytes of the input would give
    assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_columns_computed_once_for_each_distinct_input(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 7 else None, float(i % 2)) for i in range(100)], "id long, a long, b double")
    out = joins.with_once(df, ["a", "b"], {"s": F.coalesce(F.col("a") + F.col("b"), F.lit(-1.0)), "drawn": F.uuid()})
    rows = out.collect()
    assert len(rows) == 100 and all(r.s == (-1.0 if r.a is None else r.a + r.b) for r in rows)
    assert len({r.drawn for r in rows}) == len({(r.a, r.b) for r in rows}) == 8
