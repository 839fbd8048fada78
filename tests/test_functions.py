"""Column helpers against worked cases, with a case for each known trap of the data."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import arrow, geo, record, score
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return tuple(df.select(*columns).first())


def test_compass_ties(spark):
    rows = spark.createDataFrame([(22.5,), (67.5,), (112.5,), (0.0,), (360.0,)], "x double").select(geo.compass8(F.col("x")), geo.compass8(F.col("x"), "half_even"), geo.compass16(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["东北", "东", "东南", "北", "北"]
    assert [r[1] for r in rows] == ["北", "东", "东", "北", "北"]
    assert rows[0][2] == "北偏东"


def test_distance_of_equal_and_missing_points(spark):
    p = [F.col(c) for c in "abcd"]
    df = spark.createDataFrame([(114.3, 30.6, 114.3, 30.6), (116.4, 39.9, 121.47, 31.23), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.haversine_km(*p)).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(1067, abs=3) and got[2] is None


def test_point_in_ring_and_crossing(spark):
    ring = geo.box_ring(F.lit(0), F.lit(0), F.lit(2), F.lit(2))
    other = geo.box_ring(F.lit(1), F.lit(1), F.lit(3), F.lit(3))
    assert one(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), ring), geo.in_ring(F.lit(3.0), F.lit(1.0), ring), geo.rings_cross(ring, other), geo.rings_cross(ring, geo.box_ring(F.lit(5), F.lit(5), F.lit(6), F.lit(6))), x=1) == (True, False, True, False)


@pytest.mark.parametrize(
    ("kind", "prediction", "reference", "expected"),
    [
        ("topological", "两者相邻", "相邻", True), ("topological", "不相邻", "相邻", True), ("topological", "境内有湖", "属于", True), ("topological", "分离", "相邻", False),
        ("directional", "东北方", "北偏东", True), ("directional", "东", "东北", False), ("metric", "150公里", "100公里", True), ("metric", "151公里", "100公里", False),
        ("metric", "1150", "1000", True), ("composite", "东北，100公里", "北偏东，约120公里", True), ("composite", "东北", "北偏东，约120公里", False), ("other", "好的呀", "好的", True),
    ],
)
def test_correct_v2(spark, kind, prediction, reference, expected):
    """"不相邻" holds "相邻", which is tried first; the same holds for "境内有" and "境内"."""
    assert one(spark, score.correct_v2(F.col("k"), F.col("p"), F.col("r")), k=kind, p=prediction, r=reference) == (expected,)


def test_v1_takes_single_characters_first(spark):
    assert one(spark, score.correct_v1(F.col("k"), F.col("p"), F.col("r")), k="directional", p="东", r="东北") == (True,)
    assert one(spark, score.correct_v1(F.col("k"), F.col("p"), F.col("r")), k="metric", p="100000米", r="100公里") == (True,)


@pytest.mark.parametrize("text", ["", "东", "东北方", "东北方向一百公里"])
def test_bleu_of_itself_needs_four_characters(spark, text):
    assert one(spark, score.bleu(F.col("a"), F.col("b")), a=text, b=text)[0] == pytest.approx(1.0 if len(text) >= 4 else 0.0)


def test_macro_f1_without_reference_words_is_one(spark):
    assert one(spark, score.keyword_f1_macro(F.col("a"), F.col("b"), V.METRIC_WORDS), a="远", b="无") == (1.0,)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(0 for _ in b)] if not row else [0] + [v for v in _next(row, x, b)]
    return row[-1]


def _next(row, x, b):
    left = 0
    for j, y in enumerate(b):
        left = row[j] + 1 if x == y else max(left, row[j + 1])
        yield left


def test_lcs_and_rouge_against_plain_python(spark):
    pairs = [("东北方向", "东北"), ("abcde", "ace"), ("", "a"), ("xyzxyz", "zyx"), ("aabbaabb", "abab")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", arrow.lcs_length("a", "b").alias("n"), arrow.rouge_l("a", "b").alias("f")).collect()
    for r in got:
        assert r.n == lcs(r.a, r.b)
        assert r.f == pytest.approx(2 * r.n / (len(r.a) + len(r.b)) if r.n else 0)


def test_fuzzy_span_is_the_best_window(spark):
    name, text = "abcdefgh", "xx abcdxfgh yy abcdefg"
    got = spark.createDataFrame([(name, text)], "n string, t string").select(arrow.fuzzy_span("n", "t").alias("s")).first().s
    best = max(difflib.SequenceMatcher(None, text[i : i + 8], name, False).ratio() for i in range(len(text) - 7))
    assert got.similarity == pytest.approx(best)


def test_json_repair(spark):
    cases = {'结果 ```json\n{"a": 1,}\n``` 完': {"a": 1}, '{"a": [1, 2': {"a": [1, 2]}, 'x {"b": "c}"} y': {"b": "c}"}, "无": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", arrow.repaired_json("t").alias("j")).collect()
    assert {r.t: r.j and json.loads(r.j) for r in got} == cases


def test_text_helpers(spark):
    assert one(spark, T.without_bias(F.col("q")), q="请判断甲是否相邻？ 请逐步推理。") == ("甲是否相邻？",)
    assert one(spark, T.has_coordinates(F.col("q")), q="位于北纬30.5度") == (True,)
    assert one(spark, T.span(F.col("n"), F.col("t"))["char_start"], n="武汉", t="从武汉出发") == (1,)
    assert one(spark, T.longest_prefix(F.col("n"), F.col("t")), n="武汉市", t="武汉") == ("武汉",)
    assert one(spark, T.name_variants(F.col("n")), n="湖北省") == (["湖北省", "湖北"],)
    assert one(spark, T.pair_key(F.array(F.col("a"))), a="x") == (None,)


def test_records(spark):
    infer = record.infer_relation(F.col("q"), F.col("a"))
    assert [one(spark, infer, q=q, a=a)[0] for q, a in [("距离多少", ""), ("位于哪里", ""), ("在哪个方向", ""), ("你好", "")]] == ["metric", "topological", "directional", "composite"]
    types = F.array(F.lit("province"), F.lit("city"))
    assert one(spark, record.difficulty_score(F.lit("metric"), F.lit(None).cast("string"), types), x=1)[0] == pytest.approx(1.7)
    river = F.array(F.lit("river"), F.lit("city"))
    got = one(spark, record.difficulty_score(F.lit("metric"), F.lit("x"), river), record.difficulty_score(F.lit("metric"), F.lit("x"), river, strict_compat=True), x=1)
    assert got == (pytest.approx(2.0), pytest.approx(1.8))
    assert one(spark, record.topology_label(F.col("x")), x=" Inside ") == ("within",)
    chain = F.array(F.struct(F.lit(1).alias("step"), F.lit("a").alias("content")))
    assert [s.content for s in one(spark, record.five_steps(chain), x=1)[0]] == ["a", "", "", "", ""]


def test_regions(spark):
    cases = {(100.0, 30.0): "西南", (104.9, 35.0): "西北", (107.0, 43.0): "西北", (107.0, 36.0): "华北", (107.0, 35.0): "西南", (112.0, 43.0): "东北", (112.0, 30.0): "华中", (118.0, 30.0): "华东", (118.0, 28.0): "东南", (122.0, 31.0): "华东", (125.0, 30.0): "东南", (125.0, 45.0): "东北"}
    rows = spark.createDataFrame(list(cases), "lon double, lat double").select("lon", "lat", record.region_of(F.col("lon"), F.col("lat")).alias("r")).collect()
    assert {(r.lon, r.lat): r.r for r in rows} == cases


def test_relation_given_or_inferred(spark):
    rows = [("other", None, "x", "y", None), (None, "north_of", "两地同时", "", None), (None, "north_of", "q", "a", "both of them"), (None, "Overlaps", "q", "a", None), (None, "distance", "q", None, None), (None, None, "q", "a", None)]
    df = spark.createDataFrame(rows, "given string, label string, q string, a string, why string")
    got = [r[0] for r in df.select(record.relation_or_inferred(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["other", "composite", "composite", "topological", "metric", "composite"]


def test_relation_categories(spark):
    cases = {"topological.contains": "C1", "topological.touches": "unknown", "topological.adjacent": "C2", "x.directional": "directional", "metric": "metric", "composite.sameside": "C4"}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", record.relation_category(F.col("r")).alias("c")).collect()
    assert {r.r: r.c for r in rows} == cases


def test_loose_scorer_needs_a_shared_word_group(spark):
    rows = [("topological", "分离", "包含", False), ("topological", "它们接壤", "相邻", True), ("topological", "不相邻", "否", True), ("metric", "110公里", "100公里", True), ("metric", "111公里", "100公里", False), ("other", "包含", "包含", False)]
    df = spark.createDataFrame(rows, "k string, p string, r string, ok boolean")
    assert all(r[0] == r.ok for r in df.select(score.loosely_correct(F.col("k"), F.col("p"), F.col("r")), "ok").collect())


def test_containment_in_a_concave_ring(spark):
    from lodestar.functions import polygon

    ring = lambda *p: [(float(x), float(y)) for x, y in (*p, p[0])]
    u = ring((0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6))
    cases = [
        (ring((2, 3), (4, 3), (4, 5), (2, 5)), False), (ring((2, 2), (4, 2), (4, 6), (2, 6)), False), (ring((0, 0), (6, 0), (6, 2), (0, 2)), True), (ring((0, 0), (2, 0), (2, 6), (0, 6)), True),
        (ring((1, 1), (5, 1), (5, 1.5), (1, 1.5)), True), (ring((1, 1), (5, 1), (5, 3), (1, 3)), False), (ring((7, 7), (8, 7), (8, 8)), False), (u, True),
    ]
    df = spark.createDataFrame([(u, r, ok) for r, ok in cases], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>, ok boolean")
    assert [(r[0], r[1]) for r in df.select(polygon.contains(F.col("a"), F.col("b")), "ok").collect()] == [(ok, ok) for _, ok in cases]
    centre = df.select(polygon.contains_centroid(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in centre][:4] == [False, False, True, True]
    crosses = spark.createDataFrame([([(1.0, 1.0), (9.0, 1.0)], u), ([(1.0, 1.0), (5.0, 1.0)], u), ([(1.0, 4.0), (5.0, 4.0)], u)], "l array<struct<x:double,y:double>>, r array<struct<x:double,y:double>>")
    assert [r[0] for r in crosses.select(polygon.line_crosses(F.col("l"), F.col("r"))).collect()] == [True, False, True]


def test_ranks_of_large_groups(spark):
    from lodestar.operators import sampling

    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"))
    for keys in ([], ["g"]):
        rows = sampling.ranked(df, keys, "id", 42, "r", "n").collect()
        plain = df.withColumn("r", sampling._rank(keys, "id", 42)).collect()
        assert {r.id: r.r for r in rows} == {r.id: r.r for r in plain}
        sizes = df.groupBy(*keys).count().collect()
        assert {r.n for r in rows} == {r["count"] for r in sizes}
