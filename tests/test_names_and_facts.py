"""Names in texts, names looked up through variants, and known facts, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from lodestar.functions import chain, geo
from lodestar.functions import vocabulary as V
from lodestar.operators import facts, names


def test_spans_are_leftmost_and_longest(spark):
    rng = random.Random(3)
    letters = "城市甲乙丙丁ab"
    listed = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(10_000)})
    table = {v: f"n{i % 50}" for i, v in enumerate(listed)}
    texts = ["".join(rng.choice(letters + "。 𝄞") for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r.s for r in df.select("i", names.spans(F.col("t"), table).alias("s")).collect()}
    pattern = re.compile("|".join(map(re.escape, sorted(listed, key=len, reverse=True))))
    for i, t in enumerate(texts):
        want = None if t is None else [(table[m.group()], m.group(), m.start(), m.end()) for m in pattern.finditer(t)]
        assert (got[i] if got[i] is None else [tuple(s) for s in got[i]]) == want
    assert all(r.s == [] for r in df.where("t is not null").select(names.spans(F.col("t"), {}).alias("s")).collect())


def test_coverage_lists_absent_names(spark):
    texts = spark.createDataFrame([("北京市在河北",), ("北京与河北省",), (None,), ("",)], "t string")
    listed = spark.createDataFrame([("北京市",), ("河北省",), ("海南省",), ("海南省",), ("",), (None,)], "name string")
    assert {r.name: r.n for r in names.coverage(texts, "t", listed).collect()} == {"北京市": 2, "河北省": 2, "海南省": 0}


def test_lookup_prefers_name_then_alias_then_suffix(spark):
    known = spark.createDataFrame([("g", "北京市"), ("g", "长江"), ("h", "北京"), ("g", None)], "grp string, name string")
    rows = spark.createDataFrame([(1, "g", "北京"), (2, "g", "北京市"), (3, "g", "扬子江"), (4, "h", "北京市"), (5, "g", "黄河"), (6, "g", None), (7, "x", "北京"), (8, "g", ""), (8, "g", "")], "id int, grp string, found_as string")
    out = names.lookup(rows, "found_as", known, group="grp", aliases={"长江": ["扬子江"]})
    assert out.columns == ["id", "grp", "found_as", "found", "how"] and out.count() == 9
    assert {r.id: (r.found, r.how) for r in out.collect()} == {1: ("北京市", "suffix"), 2: ("北京市", "name"), 3: ("长江", "alias"), 4: ("北京", "suffix"), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_facts_by_kind(spark):
    schema = "entity string, kind string, lon double, lat double, text string, items array<string>"
    stated = [
        ("北京市", "position", 116.4, 39.9, None, None), ("上海", "position", 125.0, 31.2, None, None), ("外地", "position", 10.0, 10.0, None, None), ("无处", "position", None, 3.0, None, None),
        ("长江", "origin", None, None, "青海唐古拉山脉", None), ("黄河", "origin", None, None, "秦岭", None), ("黄河", "mouth", None, None, None, None), ("秦岭", "peak", None, None, "太白", None),
        ("太湖", "provinces", None, None, None, ["江苏", "安徽"]), ("河北", "neighbours", None, None, None, ["北京", "月球"]), ("新名", "peak", None, None, "x", None),
    ]
    known = [
        ("北京", "position", 116.0, 40.1, None, None), ("上海", "position", 121.5, 31.2, None, None), ("长江", "origin", None, None, "唐古拉山脉 各拉丹冬", None), ("黄河", "origin", None, None, "青海 巴颜喀拉山", None),
        ("秦岭", "peak", None, None, "太白山", None), ("太湖", "provinces", None, None, None, ["江苏", "浙江"]), ("河北", "neighbours", None, None, None, ["北京", "天津"]),
    ]
    got = {(r.entity, r.kind, r.issue, r.severity) for r in facts.fact_issues(spark.createDataFrame(stated, schema), spark.createDataFrame(known, schema)).collect()}
    assert got == {
        ("上海", "position", "displaced", "critical"), ("外地", "position", "outside", "critical"), ("无处", "position", "empty", "warning"), ("黄河", "origin", "different", "error"), ("黄河", "mouth", "empty", "warning"),
        ("秦岭", "peak", "different", "error"), ("太湖", "provinces", "missing", "error"), ("太湖", "provinces", "extra", "error"), ("河北", "neighbours", "missing", "error"),
    }
    lists = spark.createDataFrame([("a", ["b", "c", "z"]), ("b", ["a"]), ("c", ["b"])], "entity string, items array<string>")
    assert {tuple(r) for r in facts.one_sided(lists).collect()} == {("a", "c"), ("c", "b")}


def test_odd_direction_wording_can_fail(spark):
    """A text worded 正东 alone fails. Looking for one of the eight in the whole text would find 东 in it, and nothing could fail."""
    rows = spark.createDataFrame([("位于正东",), ("位于正东，即东方",), ("在北偏东",), ("没有方向",), ("东北",)], "t string")
    assert [r.ok for r in rows.select(chain.direction_worded(F.col("t")).alias("ok")).collect()] == [False, True, False, True, True]


def test_compatible_directions_by_the_tables(spark):
    words = sorted({w for x in (V.DIRECTION_ALIASES, V.PARTIAL_DIRECTIONS, V.MAIN_DIRECTIONS.values(), [V.DIRECTIONS_20]) for ws in x for w in ws})
    go = lambda a, b: a == b or any(a in s and b in s for s in V.DIRECTION_ALIASES + V.PARTIAL_DIRECTIONS) or b in V.MAIN_DIRECTIONS.get(a, []) or a in V.MAIN_DIRECTIONS.get(b, [])
    df = spark.createDataFrame([(a, b) for a in words for b in words] + [(None, "东")], "a string, b string")
    got = df.select("a", "b", geo.compatible_directions(F.col("a"), F.col("b")).alias("ok")).collect()
    assert all(r.ok == (r.a is not None and go(r.a, r.b)) for r in got)
