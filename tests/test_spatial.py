"""Geometry formats, relations and the spatial join against plain Python."""

import itertools
import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry as G
from lodestar.functions.relate import FACTS, NAMES, Shape, relate, relate_many
from lodestar.operators.spatial import Classes, candidates, expanded, spatial_join

WKT = [
    "POINT (1 2)", "POINT EMPTY", "LINESTRING (0 0, 1.5 2, -3 4.25)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",
    "MULTIPOINT (1 2, 3 4)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 5))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5), (6 6, 7 6, 7 6.5, 6 6)))",
    "POLYGON EMPTY", "MULTIPOLYGON EMPTY", "MULTIPOINT EMPTY", "LINESTRING EMPTY",
]


def test_formats_go_round(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WKT)], "i int, wkt string").repartition(3)
    g = df.select("i", "wkt", G.from_wkt(F.col("wkt")).alias("g"))
    out = g.select("*", G.to_wkt(F.col("g")).alias("again"), G.to_geojson(F.col("g")).alias("json"), G.to_wkb(F.col("g")).alias("wkb"), G.n_points(F.col("g")).alias("n"))
    out = out.select("*", G.from_geojson(F.col("json")).alias("from_json"), G.from_wkb(F.col("wkb")).alias("from_wkb")).orderBy("i").collect()
    assert [r.again for r in out] == WKT
    for r in out:
        assert r.from_json == r.g == r.from_wkb, r.wkt
        assert json.loads(r.json)["type"].upper() == r.g.kind
    assert [r.n for r in out] == [1, 0, 3, 10, 2, 5, 12, 0, 0, 0, 0]


def test_other_spellings_and_broken_text(spark):
    text = ["point(1 2)", "SRID=4326;POINT Z (1 2 3)", " POINT ZM (+1 2. 3 4)", "MULTIPOINT ((1 2),(3 4))", "LINESTRING(.5 1e1,2E-1 3)", "GEOMETRYCOLLECTION (POINT (1 2))", "nonsense", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string")
    got = [r.w for r in df.select("i", G.to_wkt(G.from_wkt(F.col("t"))).alias("w")).orderBy("i").collect()]
    assert got == ["POINT (1 2)", "POINT (1 2)", "POINT (1 2)", "MULTIPOINT (1 2, 3 4)", "LINESTRING (0.5 10, 0.2 3)", None, None, None, None]
    text = ["[116.5, 40]", '{"type": "Point", "coordinates": [1, 2, 3]}', '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', '{"type":"GeometryCollection","geometries":[]}', "{", "7", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string")
    got = [r.w for r in df.select("i", G.to_wkt(G.from_geojson(F.col("t"))).alias("w")).orderBy("i").collect()]
    assert got == ["POINT (116.5 40)", "POINT (1 2)", "POLYGON ((0 0, 1 0, 1 1, 0 0))", None, None, None, None]
    raw = [
        struct.pack(">BIdd", 0, 1, 1, 2), struct.pack("<BIIddd", 1, 0x20000001 | 0x80000000, 4326, 1, 2, 3), struct.pack("<BIIdddd", 1, 1002, 1, 1, 2, 3, 4)[:33], struct.pack("<BI", 1, 7), b"", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t binary")
    got = [r.w for r in df.select("i", G.to_wkt(G.from_wkb(F.col("t"))).alias("w")).orderBy("i").collect()]
    assert got == ["POINT (1 2)", "POINT (1 2)", "LINESTRING (1 2)", None, None, None]


def test_centroid_and_points_in_holes(spark):
    df = spark.createDataFrame([(WKT[3],), ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((4 0, 4 2, 6 2, 6 0, 4 0)))",), ("LINESTRING (0 0, 1 1)",)], "w string")
    g = G.from_wkt(F.col("w"))
    rows = df.select(G.centroid(g).alias("c"), G.holds_point(g, F.lit(1.5), F.lit(1.5)).alias("one"), G.holds_point(g, F.lit(5.0), F.lit(1.0)).alias("five"), G.bounds(g).alias("b")).collect()
    a = (16 * 2 - 1.5) / 15
    assert (rows[0].c.x, rows[0].c.y) == pytest.approx((a, a)) and (rows[1].c.x, rows[1].c.y) == pytest.approx((3, 1)) and rows[2].c is None
    assert [r.one for r in rows[:2]] == [False, True] and [r.five for r in rows[:2]] == [False, True]
    assert tuple(rows[1].b) == (0, 0, 6, 2)


def outline(cells):
    """Closed rings round a set of unit squares."""
    edges = {}
    for x, y in cells:
        square = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        for k in range(4):
            p, q = square[k], square[(k + 1) % 4]
            if (q, p) in edges:
                del edges[q, p]
            else:
                edges[p, q] = True
    after = {}
    for p, q in edges:
        after.setdefault(p, []).append(q)
    rings = []
    while after:
        start = at = next(iter(after))
        ring = [start]
        while True:
            at_next = after[at].pop()
            if not after[at]:
                del after[at]
            ring.append(at_next)
            at = at_next
            if at == start:
                break
        rings.append(np.array(ring, float))
    return rings


def areas(seed, n, size=5):
    rng = random.Random(seed)
    return [{(x, y) for x in range(rng.randint(1, size)) for y in range(rng.randint(1, size)) if rng.random() < rng.choice((0.5, 0.8, 1.0))} or {(0, 0)} for _ in range(n)]


def moved(cells, dx, dy):
    return {(x + dx, y + dy) for x, y in cells}


def expected(a, b):
    corners = lambda s: {(x + i, y + j) for x, y in s for i in (0, 1) for j in (0, 1)}
    meet = bool(a & b)
    touch = not meet and bool(corners(a) & corners(b))
    return {"contains": b <= a, "within": a <= b, "touches": touch, "crosses": False, "overlaps": meet and not a <= b and not b <= a, "disjoint": not meet and not touch, "equals": a == b}


def test_areas_of_unit_squares_concave_with_holes_in_parts():
    rng = random.Random(4)
    seen = {k: 0 for k in expected({(0, 0)}, {(0, 0)})}
    for a, b in zip(areas(1, 1500), areas(2, 1500), strict=True):
        b = rng.choice([moved(b, rng.randint(-4, 4), rng.randint(-4, 4)), b, set(list(a)[: 1 + len(a) // 2]), a])
        want = expected(a, b)
        got = relate(Shape("POLYGON", [outline(a)]), Shape("POLYGON", [outline(b)]))
        assert got == want, (a, b)
        for k, v in want.items():
            seen[k] += v
    assert all(n > 20 for k, n in seen.items() if k != "crosses"), seen


@pytest.mark.parametrize("angle", [0.3, 1.1])
def test_relations_do_not_depend_on_the_axes(angle):
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    rng = random.Random(9)
    for a, b in zip(areas(5, 300), areas(6, 300), strict=True):
        b = moved(b, rng.randint(-3, 3), rng.randint(-3, 3))
        got = relate(*(Shape("MULTIPOLYGON", [[r @ turn * 0.37 for r in outline(s)]]) for s in (a, b)))
        assert got == expected(a, b)


def test_lines_and_points():
    ring = np.array([[0, 0], [4, 0], [4, 4], [2, 1], [0, 4], [0, 0]], float)  # concave: a notch from above
    area = Shape("POLYGON", [[ring]])
    line = lambda *p: Shape("LINESTRING", [[np.array(p, float)]])
    true = lambda facts: {k for k, v in facts.items() if v}
    cases = [
        (line((-1, 1), (5, 1)), area, {"crosses"}), (line((0.5, 3), (3.5, 3)), area, {"crosses"}), (line((1, 3), (3, 3)), area, {"disjoint"}), (line((1.5, 3.9), (2.5, 3.9)), area, {"disjoint"}), (line((0, 0), (4, 0)), area, {"touches"}),
        (line((-1, -1), (0, 0)), area, {"touches"}), (line((1, 0.5), (3, 0.5)), area, {"within"}), (line((0, 0), (2, 0.5)), area, {"within"}), (line((0, 4), (4, 4)), area, {"touches"}),
        (line((0, 0), (2, 2)), line((0, 2), (2, 0)), {"crosses"}), (line((0, 0), (2, 2)), line((2, 2), (3, 0)), {"touches"}), (line((0, 0), (2, 0)), line((1, 0), (3, 0)), {"overlaps"}),
        (line((0, 0), (3, 0)), line((1, 0), (2, 0)), {"contains"}), (line((0, 0), (3, 0)), line((1, 0), (1, 2)), {"touches"}), (line((0, 0), (1, 0), (2, 0)), line((0, 0), (2, 0)), {"contains", "within", "equals"}),
        (Shape("POINT", [[np.array([[2.0, 0.5]])]]), area, {"within"}), (Shape("POINT", [[np.array([[2.0, 1.0]])]]), area, {"touches"}), (Shape("POINT", [[np.array([[2.0, 2.0]])]]), area, {"disjoint"}),
        (area, Shape("POINT", [[np.array([[2.0, 0.5]])]]), {"contains"}), (area, line((1, 0.5), (3, 0.5)), {"contains"}), (Shape("POLYGON", []), area, {"disjoint"}),
    ]
    for a, b, want in cases:
        assert true(relate(a, b)) == want, (a.points.tolist(), b.points.tolist())


def wkt_of(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x:g} {y:g}" for x, y in r) + ")" for r in rings) + ")"


@pytest.mark.parametrize(("most", "deepest", "spread"), [(4096, 25, 30), (16, 25, 30), (16, 3, 3)])
def test_join_gives_each_pair_once(spark, most, deepest, spread):
    rng = random.Random(most)
    one, two = ([moved(s, rng.randint(-spread, spread), rng.randint(-spread, spread)) for s in areas(k, 120)] for k in (7, 8))
    none = spark.createDataFrame([], "id int, w string").select("id", G.from_wkt(F.col("w")).alias("g"))
    assert candidates(none, none, "id", "id", "g", "g").count() == 0
    frames = [spark.createDataFrame([(i, wkt_of(outline(s))) for i, s in enumerate(x)] + [(900, None), (None, "POINT (1 1)"), (901, "POLYGON EMPTY")], "id int, w string").select("id", G.from_wkt(F.col("w")).alias("g")) for x in (one, two)]
    pairs = [tuple(r) for r in candidates(*frames, "id", "id", "g", "g", most=most, deepest=deepest).collect()]
    span = lambda s: [f(c[k] + e for c in s) for k in (0, 1) for f, e in ((min, 0), (max, 1))]
    meets = lambda a, b: a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]
    assert sorted(pairs) == [(i, j) for (i, a), (j, b) in itertools.product(enumerate(map(span, one)), enumerate(map(span, two))) if meets(a, b)]
    got = {(r.left_id, r.right_id): r.facts.asDict() for r in spatial_join(*frames, "id", "id", "g", "g", most=most, deepest=deepest).collect()}
    want = {(i, j): expected(a, b) for (i, a), (j, b) in itertools.product(enumerate(one), enumerate(two))}
    assert got == {k: v for k, v in want.items() if not v["disjoint"]}


def test_many_pairs_at_a_time_as_one_by_one():
    rng = random.Random(3)
    line = lambda: np.array([[rng.randint(-4, 6) + rng.choice((0, 0.5)), rng.randint(-4, 6)] for _ in range(rng.randint(2, 4))], float)
    sides = [([], []), ([], [])]
    for a, b in zip(areas(1, 800), areas(2, 800), strict=True):
        b = rng.choice([moved(b, rng.randint(-4, 4), rng.randint(-4, 4)), b, set(list(a)[: 1 + len(a) // 2]), a])
        for (kinds, parts), s in zip(sides, (a, b), strict=True):
            made = rng.choices([("POLYGON", [outline(s)]), ("LINESTRING", [[line()]]), ("POINT", [[line()[:1]]]), ("POLYGON", []), (None, [])], (60, 25, 10, 3, 2))[0]
            kinds.append(made[0])
            parts.append(made[1])
    got = relate_many(*(G.nested_arrays(*s) for s in sides)).to_pylist()
    want = [None if j is None or k is None else relate(Shape(j, p), Shape(k, q)) for j, p, k, q in zip(*sides[0], *sides[1], strict=True)]
    assert got == want
    assert all(sum(bool(w and w[n]) for w in want) > 10 for n in NAMES)


def test_areas_in_many_copies_are_compared_once_and_all_paired(spark):
    wkt = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))"]
    made = lambda n, base: spark.range(n).select((F.col("id") + base).alias("id"), G.from_wkt(F.get(F.array(*map(F.lit, wkt)), (F.col("id") % 3).cast("int"))).alias("geometry"))
    one, two = made(30, 0), made(1500, 100)
    classes = Classes(two, "id", "geometry", most=16)
    assert [r.n for r in classes.distinct.collect()] == [500] * 3
    assert sorted(r.id for r in classes.members.select(F.explode("ids").alias("id")).collect()) == list(range(100, 1600))
    assert max(r.n for r in classes.members.select(F.size("ids").alias("n")).collect()) < 64
    few = Classes(one, "id", "geometry")
    pairs = few.distinct.selectExpr("rep AS left_rep").limit(1).crossJoin(classes.distinct.selectExpr("rep AS right_rep").limit(1))
    assert expanded(pairs, few, classes).distinct().count() == 10 * 500
    for a, b in ((one, two), (two, one)):  # the side of longer lists goes last either way
        got = spatial_join(a, b, "id", "id").groupBy((F.col("left_id") + (F.col("left_id") < 100).cast("int")).alias("l"), "right_id", "facts.contains", "facts.within", "facts.touches", "facts.overlaps").count()
        assert got.count() == 30 * 1500 and got.agg(F.max("count")).first()[0] == 1
        assert got.where("contains AND NOT within").count() == 10 * 500 and got.where("touches").count() == 2 * 10 * 500 and got.where("overlaps").count() == 2 * 10 * 500


def test_lines_in_many_copies_cross_as_each_alone(spark):
    area = spark.range(40).select("id", G.from_wkt(F.lit("POLYGON ((0 0, 4 0, 4 2, 2 2, 2 4, 0 4, 0 0))")).alias("geometry"))
    wkt = ["LINESTRING (3 1, 3 5)", "LINESTRING (1 1, 1 3)", "LINESTRING (3 3, 5 5)", "LINESTRING (4 0, 4 2)"]
    lines = spark.range(400).select("id", G.from_wkt(F.get(F.array(*map(F.lit, wkt)), (F.col("id") % 4).cast("int"))).alias("geometry"))
    assert Classes(lines, "id", "geometry").distinct.count() == 4
    got = spatial_join(lines, area, "id", "id", where=F.col("facts.crosses") | F.col("facts.within")).groupBy(F.col("left_id") % 4, "facts.crosses", "facts.within").count()
    assert sorted(map(tuple, got.collect())) == [(0, True, False, 4000), (1, False, True, 4000)]


def test_equal_texts_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        reads.add(1)
        return text

    area = spark.range(40).select("id", F.lit("POLYGON ((0 0, 4 0, 4 2, 2 2, 2 4, 0 4, 0 0))").alias("geometry"))
    wkt = ["LINESTRING (3 1, 3 5)", "LINESTRING (1 1, 1 3)", "LINESTRING (3.0 1, 3 5)", "LINESTRING EMPTY", "not a line", None]
    lines = spark.range(600).select("id", F.get(F.array(*map(F.lit, wkt)), (F.col("id") % 6).cast("int")).alias("geometry"))
    read = lambda text: G.from_wkt(seen(text))
    got = spatial_join(lines, area, "id", "id", left_read=read, right_read=G.from_wkt).groupBy(F.col("left_id") % 6, "facts.crosses", "facts.within").count()
    assert sorted(map(tuple, got.collect())) == [(0, True, False, 4000), (1, False, True, 4000), (2, True, False, 4000)]
    assert 5 <= reads.value <= 10  # a value may be read more than once for one row's expression, but not for each of 500 rows
    both = spatial_join(lines, lines, "id", "id", once=True, left_read=read).groupBy((F.col("left_id") % 6).alias("a"), (F.col("right_id") % 6).alias("b")).count()
    assert {tuple(sorted((r.a, r.b))) for r in both.collect()} == {(0, 0), (0, 2), (1, 1), (2, 2)}


def test_neighbours_of_one_table_once_in_either_order(spark):
    boxes = [(0, 0, 2, 2), (2, 0, 4, 2), (0, 0, 1, 1), (2, 0, 4, 2), (0, 0, 2, 2), (2, 2, 3, 3)]
    wkt = lambda a, b, c, d: wkt_of([[(a, b), (c, b), (c, d), (a, d), (a, b)]])
    df = spark.createDataFrame([(i, wkt(*b)) for i, b in enumerate(boxes)], "id int, w string").select("id", G.from_wkt(F.col("w")).alias("geometry"))
    both = {(r.left_id, r.right_id): r.facts for r in spatial_join(df, df, "id", "id").collect()}
    once = {(r.left_id, r.right_id): r.facts for r in spatial_join(df, df, "id", "id", once=True).collect()}
    assert once == {k: v for k, v in both.items() if k[0] < k[1]} and once[2, 4].within and once[0, 2].contains
    touching = spatial_join(df, df, "id", "id", where=F.col("facts.touches"), once=True)
    assert sorted(map(tuple, touching.select("left_id", "right_id").collect())) == sorted(k for k, v in once.items() if v.touches)
    within = spatial_join(df, df, "id", "id", where=F.col("facts.within"), once=True)
    assert sorted(map(tuple, within.select("left_id", "right_id").collect())) == sorted(k for k, v in once.items() if v.within)


def test_stated_relations_compare_each_pair_of_geometries_once(spark, tmp_path, monkeypatch):
    from lodestar.plans import spatial as plan

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    # keys of equal geometries (840 apart), keys without a row, and no key
    tables = {
        "customer": "SELECT range AS c_custkey FROM range(1, 60)",
        "supplier": "SELECT 840 * (range // 4) + range % 4 AS s_suppkey FROM range(20)",
        "lineitem": "SELECT range % 77 AS l_orderkey, range % 300 AS l_partkey, CASE WHEN range % 50 > 0 THEN 840 * (range % 6) + range % 5 END AS l_suppkey FROM range(4000)",
    }
    for name, body in tables.items():
        con.execute(f"COPY ({body}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    compared = spark.sparkContext.accumulator(0)

    def counted(one, two):
        @F.arrow_udf(FACTS)
        def facts(a: pa.Array, b: pa.Array) -> pa.Array:
            compared.add(len(a))
            return relate_many(a, b)

        return facts(one, two)

    monkeypatch.setattr(plan, "relations", counted)
    got = sorted(map(tuple, plan.geo_topology_report(spark, str(tmp_path)).select("category", "total", "passed").collect()))
    assert got == sorted(con.execute(f"SELECT category, total, passed FROM ({plan.ORACLES['geo_topology_report']})").fetchall())
    assert sum(total for _, total, _ in got) > 500 and 0 < compared.value <= 4 * 59
