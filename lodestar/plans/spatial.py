"""Queries over geometries: formats, joins of areas and lines, verification of stated relations, relations inferred from lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import geometry as G
from lodestar.functions.relate import relations
from lodestar.operators import closure
from lodestar.operators.spatial import Classes, spatial_join
from lodestar.plans.base import pick

# Corners as SQL of both engines; eighths of a degree, so that borders meet exactly.
_CITY = {"x0": "73 + CAST((c_custkey * c_custkey * 7 + c_custkey * 37) % 491 AS DOUBLE) / 8", "y0": "18 + CAST((c_custkey * c_custkey * 3 + c_custkey * 53) % 277 AS DOUBLE) / 8", "w": "CAST(1 + c_custkey % 3 AS DOUBLE) / 8", "h": "CAST(1 + c_custkey % 2 AS DOUBLE) / 8"}
_PROVINCE = {"x0": "73 + CAST(s_suppkey * 41 % 56 AS DOUBLE)", "y0": "18 + CAST(s_suppkey * 29 % 30 AS DOUBLE)", "w": "CAST(2 + s_suppkey % 5 AS DOUBLE)", "h": "CAST(2 + s_suppkey % 4 AS DOUBLE)"}
_LINE = {"x0": "73.03 + CAST(c_custkey * 61 % 500 AS DOUBLE) / 8", "y0": "18.07 + CAST(c_custkey * 67 % 280 AS DOUBLE) / 8", "dx": "CAST(c_custkey % 7 - 3 AS DOUBLE) + 0.017", "dy": "CAST(c_custkey % 5 - 2 AS DOUBLE) + 0.013"}


def _made(spark, sf_dir, table, key, columns):
    # a key of few bytes becomes text at some cost, so the rows are spread before
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(2 * spark.sparkContext.defaultParallelism, key)
    return rows.selectExpr(f"{key} AS id", *[f"{v} AS {k}" for k, v in columns.items()])


def _json_box(x0, y0, x1, y1):
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.array_join(F.array(*[F.format_string("[%s,%s]", x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]), ","), F.lit("]]}"))


def cities(spark, sf_dir):
    """A box for each customer, as GeoJSON."""
    c = F.col
    box = _json_box(c("x0"), c("y0"), c("x0") + c("w"), c("y0") + c("h"))
    return _made(spark, sf_dir, "customer", "c_custkey", _CITY).select("id", box.alias("geometry"))


def provinces(spark, sf_dir):
    """An L (a box without its upper right quarter) for each supplier, as well-known text."""
    c = F.col
    x0, y0, x1, y1, xm, ym = c("x0"), c("y0"), c("x0") + c("w"), c("y0") + c("h"), c("x0") + c("w") / 2, c("y0") + c("h") / 2
    ring = [(x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1), (x0, y0)]
    text = F.concat(F.lit("POLYGON (("), F.array_join(F.array(*[F.format_string("%s %s", x, y) for x, y in ring]), ", "), F.lit("))"))
    return _made(spark, sf_dir, "supplier", "s_suppkey", _PROVINCE).select("id", text.alias("geometry"))


def lines(spark, sf_dir):
    """A slanting line for each customer, as well-known text."""
    text = F.format_string("LINESTRING (%s %s, %s %s)", F.col("x0"), F.col("y0"), F.col("x0") + F.col("dx"), F.col("y0") + F.col("dy"))
    return _made(spark, sf_dir, "customer", "c_custkey", _LINE).select("id", text.alias("geometry"))


def geo_formats(spark, sf_dir):
    """Geometries of six kinds read from text or GeoJSON, written in both forms and through the binary one, with their numbers of points."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", f"{_SHAPES['wkt']} AS wkt", f"{_SHAPES['json']} AS json")
    g = df.select("k", F.when(F.col("k") % 2 == 0, G.from_wkt(F.col("wkt"))).otherwise(G.from_geojson(F.col("json"))).alias("g"))
    g = g.select("k", F.col("g.kind").alias("kind"), G.from_wkb(G.to_wkb(F.col("g"))).alias("g"))
    return g.select("k", "kind", G.to_wkt(F.col("g")).alias("wkt"), G.to_geojson(F.col("g")).alias("json"), G.n_points(F.col("g")).alias("points"))


def agg_points_by_kind(spark, sf_dir):
    """Geometries and positions of each kind, with rows without a geometry."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", f"{_SHAPES['wkt']} AS wkt")
    g = G.from_wkt(F.when(F.col("k") % 10 != 0, F.col("wkt")))
    return df.select(g.alias("g")).groupBy(F.coalesce("g.kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum(G.n_points(F.col("g"))), F.lit(0)).alias("points"))


def geo_join_areas(spark, sf_dir):
    """Every province and city with a point in common, and how they lie to each other."""
    found = spatial_join(provinces(spark, sf_dir), cities(spark, sf_dir), "id", "id", left_read=G.from_wkt, right_read=G.from_geojson)
    return found.select(F.col("left_id").alias("province"), F.col("right_id").alias("city"), "facts.contains", "facts.touches", "facts.overlaps")


def geo_join_neighbours(spark, sf_dir):
    """Pairs of cities whose borders meet while their areas do not, each once."""
    c = cities(spark, sf_dir)
    found = spatial_join(c, c, "id", "id", where=F.col("facts.touches"), once=True, left_read=G.from_geojson)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def geo_join_lines(spark, sf_dir):
    """Lines that run inside and outside of a province, and those that stay in one."""
    where = F.col("facts.crosses") | F.col("facts.within")
    found = spatial_join(lines(spark, sf_dir), provinces(spark, sf_dir), "id", "id", where=where, left_read=G.from_wkt, right_read=G.from_wkt)
    return found.select(F.col("left_id").alias("line"), F.col("right_id").alias("province"), "facts.crosses", "facts.within")


#: Relation that a pair is said to have.
_STATED = pick("l_orderkey", ["contains", "touches", "disjoint", "overlaps"])


def geo_topology_report(spark, sf_dir):
    """Stated relations of pairs of a province and a city held against their geometries, by relation; a negative pair passes if the relation
    does not hold. All pairs are verified."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = rows.selectExpr("l_suppkey AS p", "l_partkey % 150 + 1 AS q", f"{_STATED} AS stated", "l_orderkey % 5 = 0 AS negative")
    # rows of equal geometries and the same statement are counted first, whatever their ids; a pair of geometries is compared once
    named = cities(spark, sf_dir).join(pairs.select(F.col("q").alias("id")).distinct(), "id", "left_semi")
    p, q = (Classes(df, "id", "geometry", read=read) for df, read in ((provinces(spark, sf_dir), G.from_wkt), (named, G.from_geojson)))
    ids = lambda c, key, rep: c.members.select(F.explode("ids").alias(key), F.col("rep").alias(rep))
    n = pairs.join(ids(p, "p", "rp"), "p").join(ids(q, "q", "rq"), "q").groupBy("rp", "rq", "stated", "negative").agg(F.count("*").alias("n"))
    both = n.groupBy("rp", "rq").agg(F.collect_list(F.struct("stated", "negative", "n")).alias("said"))
    both = both.join(p.distinct.select(F.col("rep").alias("rp"), F.col("value").alias("a")), "rp").join(q.distinct.select(F.col("rep").alias("rq"), F.col("value").alias("b")), "rq")
    facts = both.select("said", relations(F.col("a"), F.col("b")).alias("f")).select("f", F.inline("said"))
    holds = F.coalesce(*[F.when(F.col("stated") == k, F.col(f"f.{k}")) for k in ("contains", "touches", "disjoint", "overlaps")])
    name = F.concat(F.when(F.col("negative"), "negative_").otherwise(""), "stated")
    passed = F.sum(F.when(holds != F.col("negative"), F.col("n")).otherwise(0))
    return facts.groupBy(name.alias("category")).agg(F.sum("n").alias("total"), passed.alias("passed"))


def geo_inferred(spark, sf_dir):
    """Containment through all levels from the parent of each entity, neighbours both ways from one-way lists, siblings that are neither."""
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    parents = ids.selectExpr("CAST(floor(id / 4) AS BIGINT) AS parent", "id AS child").where("parent > 0")
    within = closure.transitive(parents.selectExpr("parent AS a", "child AS b"))
    adjacent = closure.neighbours(ids.selectExpr("id AS a", "id + 1 AS b").join(ids.select(F.col("id").alias("b")), "b", "left_semi").where("a % 3 <> 0").select("a", "b"))
    apart = closure.siblings_apart(parents, adjacent)
    out = within.selectExpr("'contains' AS relation", "a", "b", "steps").union(adjacent.selectExpr("'adjacent'", "a", "b", "1"))
    return out.union(apart.selectExpr("'disjoint'", "a", "b", "2"))


def _coordinates(form: str) -> str:
    """SQL text of one of six geometries of a key, as text or GeoJSON."""
    json = form == "json"
    n = lambda e: f"CAST({e} AS BIGINT)"
    p = lambda x, y: (f"concat('[', {n(x)}, ',', {n(y)}, ']')" if json else f"concat({n(x)}, ' ', {n(y)})")
    left, right, sep = ("'['", "']'", "','") if json else ("'('", "')'", "', '")
    many = lambda *items: "concat(" + left + ", " + f", {sep}, ".join(items) + ", " + right + ")"
    k = "o_orderkey"
    box = lambda x, y, s: many(p(x, y), p(f"{x} + {s}", y), p(f"{x} + {s}", f"{y} + {s}"), p(x, y))
    line = many(p(f"{k} % 97", f"{k} % 53"), p(f"{k} % 31", f"-{k} % 17"), p("5", "7"))
    area = many(box(f"{k} % 50", f"{k} % 40", 9), box(f"{k} % 50 + 3", f"{k} % 40 + 1", 1))
    point = p(f"{k} % 180", f"-{k} % 80")
    bodies = [point if json else many(point), line, area, many(point, p("1", "2")), many(line, many(p("0", "0"), p("1", "1"))), many(area, many(box("100", f"{k} % 40", 4)))]
    out = []
    for name, body in zip(G.KINDS, bodies, strict=True):
        out.append(f"concat('{{\"type\":\"{name}\",\"coordinates\":', {body}, '}}')" if json else f"concat('{name.upper()} ', {body})")
    return f"CASE {k} % 6 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(out)) + " END"


_SHAPES = {form: _coordinates(form) for form in ("wkt", "json")}
_KIND = pick("o_orderkey", [k.upper() for k in G.KINDS])
_POINTS = "CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 8 WHEN 3 THEN 2 WHEN 4 THEN 5 ELSE 12 END"

_C = "c AS (SELECT c_custkey AS c, x0 AS a0, y0 AS b0, x0 + w AS a1, y0 + h AS b1 FROM (SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in _CITY.items()) + " FROM customer))"
_P = "p AS (SELECT s_suppkey AS p, x0, y0, x0 + w AS x1, y0 + h AS y1, x0 + w / 2 AS xm, y0 + h / 2 AS ym FROM (SELECT s_suppkey, " + ", ".join(f"{v} AS {k}" for k, v in _PROVINCE.items()) + " FROM supplier))"
_L = "l AS (SELECT c_custkey AS l, " + ", ".join(f"{v} AS {k}" for k, v in _LINE.items()) + " FROM customer)"
# an L is its lower half and its upper left quarter
_OVER = "((a0 < x1 AND a1 > x0 AND b0 < ym AND b1 > y0) OR (a0 < xm AND a1 > x0 AND b0 < y1 AND b1 > y0))"
_NEAR = "((a0 <= x1 AND a1 >= x0 AND b0 <= ym AND b1 >= y0) OR (a0 <= xm AND a1 >= x0 AND b0 <= y1 AND b1 >= y0))"
_IN = "(a0 >= x0 AND a1 <= x1 AND b0 >= y0 AND b1 <= y1 AND NOT (a1 > xm AND b1 > ym))"


def _clip(x0, y0, x1, y1):
    """The length, of 1, of the line's part in a box."""
    span = lambda v, d, lo, hi: (f"least(({lo} - l.{v}) / l.{d}, ({hi} - l.{v}) / l.{d})", f"greatest(({lo} - l.{v}) / l.{d}, ({hi} - l.{v}) / l.{d})")
    (a, b), (c, d) = span("x0", "dx", x0, x1), span("y0", "dy", y0, y1)
    return f"greatest(0, least(1, {b}, {d}) - greatest(0, {a}, {c}))"


ORACLES = {
    "geo_formats": f"SELECT o_orderkey AS k, {_KIND} AS kind, {_SHAPES['wkt']} AS wkt, {_SHAPES['json']} AS json, {_POINTS} AS points FROM orders",
    "agg_points_by_kind": f"SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'none' ELSE {_KIND} END AS kind, count(*) AS n, sum(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE {_POINTS} END)::BIGINT AS points FROM orders GROUP BY 1",
    "geo_join_areas": f"WITH {_C}, {_P} SELECT p AS province, c AS city, {_IN} AS contains, NOT {_OVER} AS touches, {_OVER} AND NOT {_IN} AS overlaps FROM p JOIN c ON {_NEAR}",
    "geo_join_neighbours": f"WITH {_C} SELECT one.c AS a, two.c AS b FROM c one JOIN c two ON one.c < two.c AND one.a0 <= two.a1 AND two.a0 <= one.a1 AND one.b0 <= two.b1 AND two.b0 <= one.b1 AND NOT (one.a0 < two.a1 AND two.a0 < one.a1 AND one.b0 < two.b1 AND two.b0 < one.b1)",
    "geo_join_lines": f"""WITH {_L}, {_P}, m AS (SELECT l, p, {_clip('p.x0', 'p.y0', 'p.x1', 'p.ym')} + {_clip('p.x0', 'p.ym', 'p.xm', 'p.y1')} AS part FROM l, p)
        SELECT l AS line, p AS province, part < 1 - 1e-9 AS crosses, part >= 1 - 1e-9 AS within FROM m WHERE part > 1e-9""",
    "geo_topology_report": f"""WITH {_C}, {_P}, r AS (SELECT l_suppkey AS p, l_partkey % 150 + 1 AS c, {_STATED} AS stated, l_orderkey % 5 = 0 AS negative FROM lineitem),
        f AS (SELECT stated, negative, CASE stated WHEN 'contains' THEN {_IN} WHEN 'touches' THEN {_NEAR} AND NOT {_OVER} WHEN 'disjoint' THEN NOT {_NEAR} ELSE {_OVER} AND NOT {_IN} END AS holds FROM r JOIN p USING (p) JOIN c USING (c))
        SELECT concat(CASE WHEN negative THEN 'negative_' ELSE '' END, stated) AS category, count(*) AS total, count(*) FILTER (WHERE holds <> negative) AS passed FROM f GROUP BY 1""",
    "geo_inferred": """WITH RECURSIVE par AS (SELECT CAST(floor(c_custkey / 4) AS BIGINT) AS parent, c_custkey AS child FROM customer WHERE c_custkey >= 4),
        reach AS (SELECT parent AS a, child AS b, 1 AS steps FROM par UNION ALL SELECT a, child, steps + 1 FROM reach JOIN par ON par.parent = reach.b),
        near AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)), adj AS (SELECT a, b FROM near UNION SELECT b, a FROM near)
        SELECT 'contains' AS relation, a, b, min(steps) AS steps FROM reach GROUP BY a, b UNION ALL SELECT 'adjacent', a, b, 1 FROM adj
        UNION ALL SELECT 'disjoint', one.child, two.child, 2 FROM par one JOIN par two ON one.parent = two.parent AND one.child < two.child WHERE (one.child, two.child) NOT IN (SELECT (a, b) FROM adj)""",
}

QUERIES = {f.__name__: f for f in (geo_formats, agg_points_by_kind, geo_join_areas, geo_join_neighbours, geo_join_lines, geo_topology_report, geo_inferred)}
