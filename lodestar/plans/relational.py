"""Queries of aggregation, profiling, joins, windows and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import stats
from lodestar.operators import joins, profile
from lodestar.operators.quality import direction_free_key
from lodestar.plans.base import frame, sql

_UNORDERED = ["geo.intersects", "geo.touches", "geo.direction"]


def _direction():
    return F.pmod(F.floor((F.col("azimuth") + 22.5) / 45), F.lit(8)).cast("int")


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def agg_counts(spark, sf_dir):
    """Counts by type with coverage of optional fields."""
    return frame(spark, sf_dir, "entities").groupBy("type").agg(F.count("*").alias("n"), F.count("geom").alias("with_geom"), F.count_distinct("name").alias("names"), F.round(F.avg(F.char_length("name")), 6).alias("name_length"))


def agg_crosstab(spark, sf_dir):
    rows = frame(spark, sf_dir, "answers").withColumn("split", F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "dev").otherwise("test"))
    return rows.groupBy("spatial_type", "difficulty").pivot("split", ["train", "dev", "test"]).count().na.fill(0)


def agg_nested(spark, sf_dir):
    """Counts of nested elements and of list sizes."""
    r = frame(spark, sf_dir, "records").select(F.array_compact(F.array("name1", "name2")).alias("names"), F.array("type1", "type2").alias("types"))
    a = r.select(F.explode("types").alias("k")).groupBy("k").agg(F.count("*").alias("n")).select(F.concat(F.lit("type:"), "k").alias("k"), "n")
    return a.unionByName(r.groupBy(F.concat(F.lit("size:"), F.size("names").cast("string")).alias("k")).agg(F.count("*").alias("n")))


def agg_pair_relations(spark, sf_dir):
    """How many unordered pairs have how many relations."""
    p = frame(spark, sf_dir, "pairs").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "relation")
    return p.groupBy("x", "y").agg(F.count_distinct("relation").alias("relations")).groupBy("relations").agg(F.count("*").alias("pairs"))


def agg_top_types(spark, sf_dir):
    """The five most frequent type pairs of each relation."""
    c = frame(spark, sf_dir, "pairs").groupBy("relation", "a_type", "b_type").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.expr("row_number() over (partition by relation order by n desc, a_type, b_type)")).where("rank <= 5")


def agg_entity_bands(spark, sf_dir):
    """Entities by how often they occur, with coverage."""
    p = frame(spark, sf_dir, "pairs")
    use = p.select(F.col("a").alias("e")).union(p.select("b")).groupBy("e").agg(F.count("*").alias("n"))
    b = F.when(F.col("n") <= 100, "1-100").when(F.col("n") <= 200, "101-200").when(F.col("n") <= 400, "201-400").otherwise("401+")
    return use.groupBy(b.alias("band")).agg(F.count("*").alias("entities"), F.round(F.count("*") / 1363, 6).alias("coverage"))


def agg_rollup(spark, sf_dir):
    return frame(spark, sf_dir, "pairs").rollup("relation", "a_type").agg(F.count("*").alias("n"), F.sum("km").alias("km"), F.grouping_id().cast("long").alias("level"))


def prof_targets(spark, sf_dir):
    target = {"directional": 0.30, "topological": 0.225, "metric": 0.225, "composite": 0.25}
    return _r(profile.against_target(frame(spark, sf_dir, "answers"), "spatial_type", target, 0.01), "share", "deviation")


def prof_drift(spark, sf_dir):
    """Distances between the relation distributions of two kinds of pairs, and to uniform."""
    p = frame(spark, sf_dir, "pairs")
    one, two = p.where("km < 1500"), p.where("km >= 1500")
    row = profile.total_variation(one, two, "relation").crossJoin(profile.kolmogorov_smirnov(one, two, "relation")).crossJoin(profile.uniform_distance(one, "relation", 9).withColumnRenamed("tvd", "uniform")).crossJoin(profile.variation(p, "a"))
    return _r(row, "tvd", "ks", "uniform", "cv")


def prof_angles(spark, sf_dir):
    """Concentration and mean of azimuths, and circular statistics of the hour of events."""
    p = frame(spark, sf_dir, "pairs").groupBy(F.lit("azimuth").alias("what")).agg(*profile.circular(F.col("azimuth").cast("double")), F.count("*").alias("n"))
    e = frame(spark, sf_dir, "events").groupBy(F.lit("hour").alias("what")).agg(*profile.circular((F.hour("ts") * 5).cast("double")), F.count("*").alias("n"))
    return p.unionByName(e).select("what", "n", F.round("r", 4).alias("r"), F.round("mean_angle", 4).alias("mean_angle"))


def prof_distances(spark, sf_dir):
    """Moments of the distance by direction."""
    p = frame(spark, sf_dir, "pairs").groupBy(_direction().alias("direction")).agg(*profile.moments(F.col("km").cast("double")))
    return p.select("direction", "n", "least", "most", F.round("mean", 4).alias("mean"), "median", F.round("std", 4).alias("std"), F.round("skew", 4).alias("skew"), F.round("kurt", 4).alias("kurt"))


def prof_bands(spark, sf_dir):
    """Distance bands with their share against uniform, and the correlation of direction and distance with its p-value."""
    edges = [0.0, 100.0, 500.0, 1000.0, 2000.0]
    p = frame(spark, sf_dir, "pairs").select(profile.band(F.col("km").cast("double"), edges).alias("band"), _direction().alias("d"), "km")
    corr = p.agg(F.corr(F.col("d").cast("double"), F.col("km").cast("double")).alias("r"), F.count("*").alias("pairs"))
    r = corr.select(F.round("r", 6).alias("r"), F.round(stats.correlation_p(F.col("r"), F.col("pairs")), 6).alias("p"))
    s = profile.shares(p, "band")
    return s.crossJoin(r).select("band", "n", F.round("share", 6).alias("share"), F.round(F.abs(F.col("share") - 0.2), 6).alias("deviation"), "r", "p")


def prof_directions(spark, sf_dir):
    """Shares of all eight directions, zero-filled."""
    d = spark.range(8).select(F.col("id").cast("int").alias("direction"))
    c = frame(spark, sf_dir, "pairs").groupBy(_direction().alias("direction")).agg(F.count("*").alias("n"))
    return d.join(c, "direction", "left").na.fill(0, ["n"]).select("direction", "n")


def prof_concentration(spark, sf_dir):
    return _r(profile.concentration(frame(spark, sf_dir, "answers").where("prediction is not null"), "prediction"), "unique_ratio", "top1_share", "top5_share")


def prof_lengths(spark, sf_dir):
    t = F.char_length("text")
    return frame(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(t).alias("chars"), F.round(F.avg(t), 6).alias("mean"), F.median(t).alias("median"), F.min(t).alias("least"), F.max(t).alias("most"), F.round(F.stddev_pop(t), 4).alias("std"))


def join_predictions(spark, sf_dir):
    """Inner join of three prediction sets on the id, and the comparison of their id sets."""
    a = frame(spark, sf_dir, "answers")
    x, y, z = a.where("id % 7 > 0").select("id", F.col("prediction").alias("x")), a.where("id % 5 > 0").select("id", F.col("other").alias("y")), a.where("id % 3 > 0").select("id", F.col("reference").alias("z"))
    n = x.join(y, "id").join(z, "id").agg(F.count("*").alias("common"), F.count_if(F.col("x") == F.col("z")).alias("right"))
    return n.crossJoin(joins.same_ids(x, y, "id"))


def join_negative_pairs(spark, sf_dir):
    """Negative examples whose pair also occurs as a positive one; the key has no order for symmetric relations."""
    p = frame(spark, sf_dir, "pairs").withColumn("key", direction_free_key(F.col("relation"), F.col("a").cast("string"), F.col("b").cast("string"), _UNORDERED))
    bad = p.where("negative").join(p.where("not negative").select("relation", "key"), ["relation", "key"], "left_semi")
    return bad.groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def join_free_candidates(spark, sf_dir):
    """Candidates whose pair and id are not taken."""
    p = frame(spark, sf_dir, "pairs").withColumn("key", F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b")))
    taken = p.where("a % 4 = 0")
    free = p.join(taken.select("key").distinct(), "key", "left_anti").join(taken.select("pair_id").distinct(), "pair_id", "left_anti")
    return free.groupBy("relation").agg(F.count("*").alias("n"))


def join_overlay(spark, sf_dir):
    """Entities with geometries replaced by those of a newer table; and a compare-and-set report."""
    e = frame(spark, sf_dir, "entities")
    new = e.where("entity_id % 4 = 1").select("entity_id", F.lit("new").alias("geom"))
    out = joins.overlay(e, new, "entity_id", ["geom"]).groupBy(F.coalesce("geom", F.lit("none")).alias("what")).agg(F.count("*").alias("n"))
    fixes = spark.createDataFrame([(1, "g", "h"), (3, "g", "h"), (4, "x", "h"), (-5, "g", "h")], "entity_id long, old string, new string")
    done, report = joins.compare_and_set(e, fixes, "entity_id", "geom")
    return out.unionByName(report.groupBy(F.col("status").alias("what")).agg(F.count("*").alias("n"))).unionByName(done.where("geom = 'h'").groupBy(F.lit("set").alias("what")).agg(F.count("*").alias("n")))


def join_listed_names(spark, sf_dir):
    """Edges from a list attribute to entities by name."""
    n = frame(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("E"), (F.col("n_nationkey") * 7 + i).cast("string")))).alias("name"))
    return n.join(frame(spark, sf_dir, "entities"), "name").groupBy("n_nationkey").agg(F.count("*").alias("edges"), F.count_distinct("entity_id").alias("entities"))


def join_other_parent(spark, sf_dir):
    """Pairs of entities of a type and of different parents, at most half a degree of latitude apart, and the sum of their ids: those of any parents
    less those of one parent. Pairs of one id do not count."""
    e = frame(spark, sf_dir, "entities").select("type", "parent", "lat", "entity_id").dropna()
    near = lambda rows, *keys: joins.band_totals(rows, ["type", *keys], "lat", 0.5, "entity_id").groupBy("type").agg(F.sum("n").alias("n"), F.sum("total").alias("ids"))
    again = e.join(e.groupBy("entity_id").agg(F.count("*").alias("times")).where("times > 1"), "entity_id", "left_semi")
    parts = [(1, near(e)), (-1, near(e, "parent")), (-1, near(again, "entity_id")), (1, near(again, "entity_id", "parent"))]
    all_parts = reduce(DataFrame.union, [part.select("type", (F.col("n") * sign).alias("n"), (F.col("ids") * sign).alias("ids")) for sign, part in parts])
    out = all_parts.groupBy("type").agg(F.sum("n").alias("n"), F.sum("ids").cast("bigint").alias("ids"))
    return out.where("n > 0")


def win_first(spark, sf_dir):
    """First row of each pair id in input order, with duplicates counted."""
    p = frame(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 1000 as k", "l_orderkey", "l_linenumber")
    r = p.withColumn("r", F.expr("row_number() over (partition by k order by l_orderkey, l_linenumber)")).withColumn("copies", F.expr("count(*) over (partition by k)"))
    return r.where("r = 1").select("k", "l_orderkey", "l_linenumber", "copies")


def win_shares(spark, sf_dir):
    """Share and running share of segments by size, with gaps to the next."""
    c = frame(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return c.selectExpr(
        "c_mktsegment", "n", "round(n / sum(n) over (), 6) as share", "round(sum(n) over (order by n desc, c_mktsegment rows unbounded preceding) / sum(n) over (), 6) as running",
        "lead(n) over (order by n desc, c_mktsegment) - n as gap", "ntile(2) over (order by n desc, c_mktsegment) as half",
    )


def set_operations(spark, sf_dir):
    """Intersection, differences and union of two key sets, as counts."""
    x = frame(spark, sf_dir, "orders").select((F.col("o_custkey") % 700).alias("k"))
    y = frame(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 900).alias("k"))
    parts = {"both": x.intersect(y), "only_x": x.subtract(y), "only_y": y.subtract(x), "all": x.union(y).distinct()}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("what"), F.count("*").alias("n"), F.sum("k").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


def top_extremes(spark, sf_dir):
    """The ten smallest and largest distances."""
    p = frame(spark, sf_dir, "pairs").groupBy("km").agg(F.count("*").alias("n"))
    return p.orderBy("km").limit(10).withColumn("end", F.lit("least")).unionByName(p.orderBy(F.desc("km")).limit(10).withColumn("end", F.lit("most")))


QUERIES = {
    f.__name__: f
    for f in (
        agg_counts, agg_crosstab, agg_nested, agg_pair_relations, agg_top_types, agg_entity_bands, agg_rollup, prof_targets, prof_drift, prof_angles, prof_distances, prof_bands,
        prof_directions, prof_concentration, prof_lengths, join_predictions, join_negative_pairs, join_free_candidates, join_overlay, join_listed_names, join_other_parent,
        win_first, win_shares, set_operations, top_extremes,
    )
}

_KEY = "CASE WHEN relation IN ('geo.intersects', 'geo.touches', 'geo.direction') THEN concat(least(a::VARCHAR, b::VARCHAR), '|', greatest(a::VARCHAR, b::VARCHAR)) ELSE concat(a, '|', b) END"
_D8 = "floor((azimuth + 22.5) / 45)::INT % 8"
_POP = "sqrt(avg(x*x) - avg(x)*avg(x))"
ORACLES = {
    "agg_counts": sql("SELECT type, count(*) AS n, count(geom) AS with_geom, count(DISTINCT name) AS names, round(avg(length(name)), 6) AS name_length FROM entities GROUP BY type", "entities"),
    "agg_crosstab": sql("SELECT spatial_type, difficulty, count(*) FILTER (WHERE id % 10 < 8) AS train, count(*) FILTER (WHERE id % 10 = 8) AS dev, count(*) FILTER (WHERE id % 10 = 9) AS test FROM answers GROUP BY ALL", "answers"),
    "agg_nested": sql("SELECT concat('type:', k) AS k, count(*) AS n FROM (SELECT unnest([type1, type2]) AS k FROM records) GROUP BY k UNION ALL SELECT concat('size:', 1 + (name2 IS NOT NULL)::INT), count(*) FROM records GROUP BY 1", "records"),
    "agg_pair_relations": sql("SELECT relations, count(*) AS pairs FROM (SELECT least(a, b), greatest(a, b), count(DISTINCT relation) AS relations FROM pairs GROUP BY 1, 2) GROUP BY 1", "pairs"),
    "agg_top_types": sql("WITH c AS (SELECT relation, a_type, b_type, count(*) AS n FROM pairs GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY relation ORDER BY n DESC, a_type, b_type) AS rank FROM c QUALIFY rank <= 5", "pairs"),
    "agg_entity_bands": sql("WITH u AS (SELECT e, count(*) AS n FROM (SELECT a AS e FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY e) SELECT CASE WHEN n <= 100 THEN '1-100' WHEN n <= 200 THEN '101-200' WHEN n <= 400 THEN '201-400' ELSE '401+' END AS band, count(*) AS entities, round(count(*) / 1363, 6) AS coverage FROM u GROUP BY 1", "pairs"),
    "agg_rollup": sql("SELECT relation, a_type, count(*) AS n, sum(km)::BIGINT AS km, grouping(relation, a_type) AS level FROM pairs GROUP BY ROLLUP (relation, a_type)", "pairs"),
    "prof_targets": sql("WITH t AS (SELECT * FROM (VALUES ('directional', 0.30::DOUBLE), ('topological', 0.225), ('metric', 0.225), ('composite', 0.25)) v(spatial_type, target)), s AS (SELECT spatial_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM answers GROUP BY 1) SELECT spatial_type, n, round(share, 6) AS share, target::DOUBLE AS target, round(abs(share - target), 6) AS deviation, abs(share - target) <= 0.01 AS ok FROM s JOIN t USING (spatial_type)", "answers"),
    "prof_drift": sql("""WITH a AS (SELECT relation, count(*) / sum(count(*)) OVER () AS p FROM pairs WHERE km < 1500 GROUP BY 1), b AS (SELECT relation, count(*) / sum(count(*)) OVER () AS q FROM pairs WHERE km >= 1500 GROUP BY 1),
        f AS (SELECT relation, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN b USING (relation)), g AS (SELECT *, abs(sum(p) OVER (ORDER BY relation) - sum(q) OVER (ORDER BY relation)) AS gap FROM f),
        v AS (SELECT stddev_samp(n) / avg(n) AS cv FROM (SELECT count(*) AS n FROM pairs GROUP BY a))
        SELECT round(sum(abs(p - q)) / 2, 6) AS tvd, round(max(gap), 6) AS ks, round((sum(abs(p - 1.0 / 9)) + (9 - count(*)) / 9.0) / 2, 6) AS uniform, (SELECT round(cv, 6) FROM v) AS cv FROM g""", "pairs"),
    "prof_angles": sql("""WITH x AS (SELECT 'azimuth' AS what, azimuth::DOUBLE AS x FROM pairs UNION ALL SELECT 'hour', hour(ts) * 5 FROM events), m AS (SELECT what, count(*) AS n, avg(cos(radians(x))) AS c, avg(sin(radians(x))) AS s FROM x GROUP BY 1)
        SELECT what, n, round(sqrt(c * c + s * s), 4) AS r, CASE WHEN sqrt(c * c + s * s) > 0.3 THEN round(fmod(degrees(atan2(s, c)) + 360, 360), 4) END AS mean_angle FROM m""", "pairs"),
    "prof_distances": sql(f"""WITH d AS (SELECT {_D8} AS direction, km::DOUBLE AS x FROM pairs), m AS (SELECT *, avg(x) OVER (PARTITION BY direction) AS mu FROM d)
        SELECT direction, count(*) AS n, min(x) AS least, max(x) AS most, round(avg(x), 4) AS mean, median(x) AS median, round(stddev_pop(x), 4) AS std, round(avg(pow(x - mu, 3)) / pow(stddev_pop(x), 3), 4) AS skew, round(avg(pow(x - mu, 4)) / pow(stddev_pop(x), 4) - 3, 4) AS kurt FROM m GROUP BY 1""", "pairs"),
    "prof_bands": sql(f"""WITH d AS (SELECT CASE WHEN km < 100 THEN '0-100' WHEN km < 500 THEN '100-500' WHEN km < 1000 THEN '500-1000' WHEN km < 2000 THEN '1000-2000' ELSE '2000+' END AS band, {_D8} AS d, km FROM pairs),
        c AS (SELECT corr(d, km) AS r, count(*) AS n FROM d), g AS (SELECT i, (n - 2) / 2.0 AS a, (1 - abs(r)) / 40000 AS h, abs(r) + (1 - abs(r)) * i / 40000 AS s FROM c, range(40001) t(i)),
        v AS (SELECT sum(CASE WHEN i IN (0, 40000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 2 * pow(1 - s * s, a - 1)) * max(h) / 3 * exp(lgamma(max(a) + 0.5) - lgamma(max(a)) - lgamma(0.5)) AS p FROM g)
        SELECT band, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(abs(count(*) / sum(count(*)) OVER () - 0.2), 6) AS deviation, (SELECT round(r, 6) FROM c) AS r, (SELECT round(p, 6) FROM v) AS p FROM d GROUP BY 1""", "pairs"),
    "prof_directions": sql(f"SELECT k::INT AS direction, count(azimuth) AS n FROM (SELECT unnest(range(8)) AS k) LEFT JOIN pairs ON {_D8} = k GROUP BY 1", "pairs"),
    "prof_concentration": sql("""WITH c AS (SELECT prediction, count(*) AS n FROM answers GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, prediction) AS k, sum(n) OVER (ORDER BY n DESC, prediction) AS mass, sum(n) OVER () AS total FROM c)
        SELECT count(*) AS n_values, round(count(*) / max(total), 6) AS unique_ratio, round(sum(n) FILTER (WHERE k = 1) / max(total), 6) AS top1_share, round(sum(n) FILTER (WHERE k <= 5) / max(total), 6) AS top5_share,
        min(k) FILTER (WHERE mass >= 0.5 * total) AS cover_50, min(k) FILTER (WHERE mass >= 0.8 * total) AS cover_80, min(k) FILTER (WHERE mass >= 0.9 * total) AS cover_90 FROM r""", "answers"),
    "prof_lengths": "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, min(length(text)) AS least, max(length(text)) AS most, round(stddev_pop(length(text)), 4) AS std FROM documents GROUP BY lang",
    "join_predictions": sql("""WITH c AS (SELECT count(*) AS common, count(*) FILTER (WHERE prediction = reference) AS right FROM answers WHERE id % 7 > 0 AND id % 5 > 0 AND id % 3 > 0)
        SELECT c.*, (SELECT count(*) FROM answers WHERE id % 7 > 0 AND id % 5 = 0) AS only_first, (SELECT count(*) FROM answers WHERE id % 7 = 0 AND id % 5 > 0) AS only_second, (SELECT count(*) FROM answers WHERE id % 7 > 0 AND id % 5 > 0) AS both FROM c""", "answers"),
    "join_negative_pairs": sql(f"WITH k AS (SELECT *, {_KEY} AS key FROM pairs) SELECT relation, count(*) AS n, count(DISTINCT key) AS keys FROM k WHERE negative AND (relation, key) IN (SELECT (relation, key) FROM k WHERE NOT negative) GROUP BY 1", "pairs"),
    "join_free_candidates": sql("WITH k AS (SELECT *, concat(least(a, b), '|', greatest(a, b)) AS key FROM pairs), t AS (SELECT * FROM k WHERE a % 4 = 0) SELECT relation, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM t) AND pair_id NOT IN (SELECT pair_id FROM t) GROUP BY 1", "pairs"),
    "join_overlay": sql("""SELECT CASE WHEN entity_id % 4 = 1 THEN 'new' ELSE coalesce(geom, 'none') END AS what, count(*) AS n FROM entities GROUP BY 1 UNION ALL
        SELECT CASE WHEN e.entity_id IS NULL THEN 'not_found' WHEN e.geom IS NOT DISTINCT FROM f.old THEN 'fixed' ELSE 'mismatch' END, count(*) FROM (VALUES (1, 'g'), (3, 'g'), (4, 'x'), (-5, 'g')) f(id, old) LEFT JOIN entities e ON e.entity_id = f.id GROUP BY 1 UNION ALL SELECT 'set', count(*) FROM entities WHERE entity_id = 1""", "entities"),
    "join_listed_names": sql("SELECT n_nationkey, count(*) AS edges, count(DISTINCT entity_id) AS entities FROM (SELECT n_nationkey, concat('E', n_nationkey * 7 + unnest([1, 2, 3, 4])) AS name FROM nation) JOIN entities USING (name) GROUP BY 1", "entities"),
    "join_other_parent": sql("WITH e AS (SELECT * FROM entities) SELECT x.type, count(*) AS n, sum(x.entity_id + y.entity_id)::BIGINT AS ids FROM e x JOIN e y ON x.type = y.type AND abs(x.lat - y.lat) <= 0.5 AND x.parent <> y.parent AND x.entity_id < y.entity_id GROUP BY 1", "entities"),
    "win_first": "SELECT l_orderkey % 1000 AS k, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey % 1000) AS copies FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey % 1000 ORDER BY l_orderkey, l_linenumber) = 1",
    "win_shares": """WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY n DESC, c_mktsegment ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS running,
        lead(n) OVER (ORDER BY n DESC, c_mktsegment) - n AS gap, ntile(2) OVER (ORDER BY n DESC, c_mktsegment) AS half FROM c""",
    "set_operations": """WITH x AS (SELECT DISTINCT o_custkey % 700 AS k FROM orders), y AS (SELECT DISTINCT l_partkey % 900 AS k FROM lineitem)
        SELECT 'both' AS what, count(*) AS n, sum(k)::BIGINT AS total FROM x SEMI JOIN y USING (k) UNION ALL SELECT 'only_x', count(*), sum(k)::BIGINT FROM x ANTI JOIN y USING (k) UNION ALL SELECT 'only_y', count(*), sum(k)::BIGINT FROM y ANTI JOIN x USING (k)
        UNION ALL SELECT 'all', count(*), sum(k)::BIGINT FROM (SELECT k FROM x UNION SELECT k FROM y)""",
    "top_extremes": sql("WITH c AS (SELECT km, count(*) AS n FROM pairs GROUP BY 1) (SELECT km, n, 'least' AS \"end\" FROM c ORDER BY km LIMIT 10) UNION ALL (SELECT km, n, 'most' FROM c ORDER BY km DESC LIMIT 10)", "pairs"),
}
