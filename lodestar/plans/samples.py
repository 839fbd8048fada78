"""Queries of reproducible samples and splits, with the SQL that states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import sampling, split
from lodestar.plans.base import frame, sql


def _answers(spark, sf_dir):
    return frame(spark, sf_dir, "answers").select("id", "spatial_type", "difficulty")


def sam_stratified(spark, sf_dir):
    """Quotas by type and level, filled up to 120 rows from the rest."""
    quotas = spark.createDataFrame([("directional", "easy", 9), ("directional", "hard", 20), ("metric", "medium", 30), ("topological", "easy", 5)], "spatial_type string, difficulty string, quota int")
    return sampling.quota_with_backfill(_answers(spark, sf_dir), ["spatial_type", "difficulty"], quotas, 120, "id")


def sam_downsample(spark, sf_dir):
    return sampling.at_most(_answers(spark, sf_dir), ["spatial_type"], 25, "id", 7)


def sam_first_rows(spark, sf_dir):
    """The first 20 rows in order of each type; the cap is the feature."""
    return sampling.ranked_by(_answers(spark, sf_dir), ["spatial_type"], [F.col("id")], "r").where("r <= 20").drop("r")


def sam_bernoulli(spark, sf_dir):
    return sampling.bernoulli(_answers(spark, sf_dir), {"easy": 0.3, "medium": 0.5, "hard": 0.2}, "id", "drawn")


def sam_merge_new(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return sampling.merge_new(a.where("id % 3 = 0"), a.where("id % 4 < 2"), "id")


def sam_supplement(spark, sf_dir):
    """Pairs that fill deficits by relation and share neither id nor pair with those taken."""
    p = frame(spark, sf_dir, "pairs").groupBy("pair_id").agg(F.min(F.concat_ws("|", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))).alias("key"), F.min("relation").alias("relation"))
    deficits = spark.createDataFrame([("geo.contains", 40), ("geo.metric", 15)], "relation string, quota int")
    return sampling.supplement(p, p.where("length(pair_id) % 2 = 0"), "pair_id", "key", "relation", deficits).select("pair_id", "relation")


def sam_workers(spark, sf_dir):
    """Rows dealt to three workers by rank within type and level."""
    rows = sampling.ranked_by(_answers(spark, sf_dir), ["spatial_type", "difficulty"], [F.col("id")], "r")
    return rows.withColumn("worker", F.when(F.col("r") <= 22, 1).when(F.col("r") <= 56, 2).otherwise(3)).drop("r")


def spl_ratio(spark, sf_dir):
    return sampling.ratio_split(_answers(spark, sf_dir), ["spatial_type", "difficulty"])


def spl_pairs_by_rank(spark, sf_dir):
    """Pairs 60/20/20 by falling size per relation, with rows and pairs per split and the pairs that leak across relations."""
    p = frame(spark, sf_dir, "pairs").withColumn("key", F.concat_ws("|", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string")))
    s = split.ranked_pairs(p, "relation", "key")
    out = s.groupBy("relation", "split").agg(F.sum("n").alias("n"), F.count("*").alias("pairs"))
    leaks = split.leakage(s, "key").groupBy(F.lit("leak").alias("relation"), F.col("splits").alias("split"))
    return out.unionByName(leaks.agg(F.count("*").alias("n"), F.count("*").alias("pairs")))


def spl_drift(spark, sf_dir):
    s = sampling.ratio_split(_answers(spark, sf_dir), [])
    return split.split_drift(s, "spatial_type").withColumn("tvd", F.round("tvd", 6))


def spl_pair_exclusive(spark, sf_dir):
    """Greedy leakage-free split in cells of a hundred pairs, reduced to what must hold: how far each split is from its target, in largest pairs and
    rounded up, the pairs that are in it and in another, and the rows in all."""
    p = frame(spark, sf_dir, "pairs").withColumn("key", F.concat_ws("|", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string")))
    s = split.pair_exclusive_split(p, "key", "relation", "pair_id", cell_pairs=100)
    largest = p.groupBy("key").count().agg(F.max("count").alias("largest"), F.sum("count").alias("total"))
    per = s.groupBy("split", "key").agg(F.count("*").alias("n"))
    several = per.groupBy("key").agg(F.count("*").alias("splits"))
    goal = F.col("total") * F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    out = per.join(several, "key").groupBy("split").agg(F.sum("n").alias("n"), F.count_if(F.col("splits") > 1).alias("leaking")).crossJoin(largest)
    return out.select("split", (F.abs(F.col("n") - goal) <= F.col("largest")).alias("on_target"), "leaking", "total")


QUERIES = {f.__name__: f for f in (sam_stratified, sam_downsample, sam_first_rows, sam_bernoulli, sam_merge_new, sam_supplement, sam_workers, spl_ratio, spl_pairs_by_rank, spl_drift, spl_pair_exclusive)}
_RANK = "row_number() OVER (PARTITION BY {} ORDER BY md5(concat(id, '|{}')), id)"
_PAIR = "concat(least(a, b)::VARCHAR, '|', greatest(a, b)::VARCHAR)"
ORACLES = {
    "spl_pair_exclusive": "SELECT unnest(['train', 'dev', 'test']) AS split, true AS on_target, 0 AS leaking, (SELECT count(*) FROM lineitem) AS total",
    "sam_stratified": sql(f"""WITH q AS (SELECT * FROM (VALUES ('directional', 'easy', 9), ('directional', 'hard', 20), ('metric', 'medium', 30), ('topological', 'easy', 5)) v(spatial_type, difficulty, quota)),
        r AS (SELECT *, {_RANK.format('spatial_type, difficulty', 42)} AS r FROM answers), c AS (SELECT id, spatial_type, difficulty, CASE WHEN r <= coalesce(quota, 0) THEN 0 ELSE 1 END AS part FROM r LEFT JOIN q USING (spatial_type, difficulty))
        SELECT id, spatial_type, difficulty FROM c ORDER BY part, md5(concat(id, '|42')), id LIMIT 120""", "answers"),
    "sam_downsample": sql(f"SELECT id, spatial_type, difficulty FROM answers QUALIFY {_RANK.format('spatial_type', 7)} <= 25", "answers"),
    "sam_first_rows": sql("SELECT id, spatial_type, difficulty FROM answers QUALIFY row_number() OVER (PARTITION BY spatial_type ORDER BY id) <= 20", "answers"),
    "sam_bernoulli": sql("WITH u AS (SELECT id, spatial_type, difficulty, ('0x' || substr(md5(concat(id, '|42')), 1, 8))::BIGINT / 4294967296.0 AS u FROM answers) SELECT id, spatial_type, difficulty, CASE WHEN u < 0.3 THEN 'easy' WHEN u < 0.8 THEN 'medium' ELSE 'hard' END AS drawn FROM u", "answers"),
    "sam_merge_new": sql("SELECT id, spatial_type, difficulty FROM answers WHERE id % 3 = 0 OR id % 4 < 2", "answers"),
    "sam_supplement": sql(f"""WITH p AS (SELECT pair_id, min({_PAIR}) AS key, min(relation) AS relation FROM pairs GROUP BY 1), t AS (SELECT * FROM p WHERE length(pair_id) % 2 = 0),
        f AS (SELECT pair_id AS id, relation FROM p WHERE key NOT IN (SELECT key FROM t) AND pair_id NOT IN (SELECT pair_id FROM t)), r AS (SELECT *, {_RANK.format('relation', 42)} AS r FROM f)
        SELECT id AS pair_id, relation FROM r WHERE r <= CASE relation WHEN 'geo.contains' THEN 40 WHEN 'geo.metric' THEN 15 ELSE 0 END""", "pairs"),
    "sam_workers": sql("WITH r AS (SELECT id, spatial_type, difficulty, row_number() OVER (PARTITION BY spatial_type, difficulty ORDER BY id) AS r FROM answers) SELECT id, spatial_type, difficulty, CASE WHEN r <= 22 THEN 1 WHEN r <= 56 THEN 2 ELSE 3 END AS worker FROM r", "answers"),
    "spl_ratio": sql(f"WITH r AS (SELECT id, spatial_type, difficulty, {_RANK.format('spatial_type, difficulty', 42)} AS r, count(*) OVER (PARTITION BY spatial_type, difficulty) AS n FROM answers) SELECT id, spatial_type, difficulty, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM r", "answers"),
    "spl_pairs_by_rank": sql(f"""WITH k AS (SELECT relation, {_PAIR} AS key FROM pairs), g AS (SELECT relation, key, count(*) AS n FROM k GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY n DESC, key) AS r, count(*) OVER (PARTITION BY relation) AS t FROM g),
        s AS (SELECT *, CASE WHEN r <= floor(t * 0.6 + 1e-9) THEN 'train' WHEN r <= floor(t * 0.6 + 1e-9) + floor(t * 0.2 + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM r),
        l AS (SELECT key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s GROUP BY key HAVING count(DISTINCT split) > 1)
        SELECT relation, split, sum(n)::BIGINT AS n, count(*) AS pairs FROM s GROUP BY ALL UNION ALL SELECT 'leak', splits, count(*), count(*) FROM l GROUP BY splits""", "pairs"),
    "spl_drift": sql("""WITH r AS (SELECT spatial_type, row_number() OVER (ORDER BY md5(concat(id, '|42')), id) AS r, count(*) OVER () AS n FROM answers), s AS (SELECT spatial_type, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM r),
        q AS (SELECT spatial_type, count(*) / (SELECT count(*) FROM s) AS q FROM s GROUP BY 1), t AS (SELECT split, count(*) AS total FROM s GROUP BY 1), c AS (SELECT split, spatial_type, count(*) AS n FROM s GROUP BY ALL)
        SELECT t.split, total AS n, round(sum(abs(coalesce(c.n, 0) / total - q)) / 2, 6) AS tvd FROM t CROSS JOIN q LEFT JOIN c ON c.split = t.split AND c.spatial_type = q.spatial_type GROUP BY ALL""", "answers"),
}
