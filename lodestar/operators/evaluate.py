"""Evaluation of predictions: one pass over the rows, one grouping-sets aggregate for all groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import arrow, score
from lodestar.functions import vocabulary as V

FAMILIES = {"directions": V.DIRECTIONS_20, "topological": V.TOPOLOGY_CONFIGURED, "metric": V.METRIC_WORDS}


def scored(predictions: DataFrame, version: str = "v2", rouge: bool = False, kind: str = "spatial_type") -> DataFrame:
    """Every per-row figure of the report: correct, format_ok, bleu4, rouge_l, and keyword counts by family and overall."""
    k, p, r = F.col(kind), F.col("prediction"), F.col("reference")
    correct = {"v2": score.correct_v2, "v1": score.correct_v1}[version](k, p, r)
    bleu = score.bleu(p, r) if version == "v2" else score.bleu(p, r, smoothing=1e-10, strict_penalty=True)
    counts = {}
    for name, words in FAMILIES.items():
        counts |= dict(zip((f"tp_{name}", f"fp_{name}", f"fn_{name}"), score.keyword_counts(p, r, words), strict=True))
    out = predictions.withColumns({"correct": correct, "format_ok": score.format_valid(p), "bleu4": bleu} | counts)
    out = out.withColumns({x: sum((F.col(f"{x}_{f}") for f in FAMILIES), F.lit(0)) for x in ("tp", "fp", "fn")})
    return out.withColumn("rouge_l", arrow.rouge_l(p, r)) if rouge else out


def report(rows: DataFrame, groups: tuple[str, ...] = ("spatial_type", "difficulty")) -> DataFrame:
    """Figures overall and for each value of each group column, from scored rows, in one aggregate: scope, grp, total,
    correct, accuracy, format_rate, bleu4, keyword_f1 (micro), and rouge_l if it was scored."""
    figures = [
        F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg(F.col("format_ok").cast("int")).alias("format_rate"),
        F.avg("bleu4").alias("bleu4"), score.f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("keyword_f1"),
    ]
    if "rouge_l" in rows.columns:
        figures.append(F.avg("rouge_l").alias("rouge_l"))
    cols = [F.col(g) for g in groups]
    sets = [[], *[[c] for c in cols]]
    out = rows.groupingSets(sets, *cols).agg(F.grouping_id().alias("gid"), *figures)
    scope, value, full = F.lit("overall"), F.lit("all"), (1 << len(groups)) - 1
    for i, g in enumerate(groups):
        one = F.col("gid") == full - (1 << (len(groups) - 1 - i))
        scope, value = F.when(one, F.lit(g)).otherwise(scope), F.when(one, F.col(g)).otherwise(value)
    return out.select(scope.alias("scope"), value.alias("grp"), *[c for c in out.columns if c not in (*groups, "gid")])


def agreement(answers: DataFrame, id_col: str = "id", model: str = "model", answer: str = "prediction") -> DataFrame:
    """Share of common ids on which each two models give the same answer: model_a, model_b, n, agreement."""
    a = answers.select(id_col, F.col(model).alias("model_a"), F.col(answer).alias("x"))
    b = answers.select(id_col, F.col(model).alias("model_b"), F.col(answer).alias("y"))
    same = F.avg(F.trim("x").eqNullSafe(F.trim("y")).cast("int"))
    return a.join(b, id_col).where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count("*").alias("n"), same.alias("agreement"))


def head_to_head(one: DataFrame, two: DataFrame, groups: tuple[str, ...] = ("spatial_type", "difficulty"), id_col: str = "id") -> DataFrame:
    """Wins of two scored prediction sets over common ids, overall and by group: only_one, only_two, both, neither."""
    a = one.select(id_col, *groups, F.col("correct").alias("a"))
    both = a.join(two.select(id_col, F.col("correct").alias("b")), id_col)
    figures = [F.count_if(c).alias(n) for n, c in (("only_one", F.col("a") & ~F.col("b")), ("only_two", ~F.col("a") & F.col("b")), ("both", F.col("a") & F.col("b")), ("neither", ~F.col("a") & ~F.col("b")))]
    cols = [F.col(g) for g in groups]
    out = both.groupingSets([[], *[[c] for c in cols]], *cols).agg(F.grouping_id().alias("gid"), *figures)
    full, scope, value = (1 << len(groups)) - 1, F.lit("overall"), F.lit("all")
    for i, g in enumerate(groups):
        hit = F.col("gid") == full - (1 << (len(groups) - 1 - i))
        scope, value = F.when(hit, F.lit(g)).otherwise(scope), F.when(hit, F.col(g)).otherwise(value)
    return out.select(scope.alias("scope"), value.alias("grp"), "only_one", "only_two", "both", "neither")


def errors(rows: DataFrame, kind: str = "spatial_type") -> DataFrame:
    """Wrong rows with their cause."""
    parts = score.error_parts(F.col("prediction"), F.col("reference"))
    wrong = rows.where(~F.col("correct")).withColumns({f"__{k}": v for k, v in parts.items()})
    cause = score.error_cause(F.col(kind), {k: F.col(f"__{k}") for k in parts})
    return wrong.withColumn("cause", cause).drop(*[f"__{k}" for k in parts])


def metric_diff(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute and relative difference of two long metric tables (keys and a column value)."""
    a, b = one.withColumnRenamed("value", "a"), two.withColumnRenamed("value", "b")
    return a.join(b, keys, "full_outer").select(*keys, "a", "b", (F.col("b") - F.col("a")).alias("difference"), ((F.col("b") - F.col("a")) / F.nullif(F.abs("a"), F.lit(0.0))).alias("relative"))


def leaderboard(runs: DataFrame, metric: str) -> DataFrame:
    """Runs with their rank by a metric; ties share a rank. Runs are few: the window is over the whole table of runs."""
    return runs.withColumn("rank", F.rank().over(W.partitionBy().orderBy(F.desc(metric))))


def judged(reply: Column, names: tuple[str, ...] = ("accuracy", "completeness", "clarity"), default: int = 3) -> Column:
    """Scores from a judge's reply: its JSON object, else `name: digit` in the text, else the default."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    fields = []
    for n in names:
        parsed = F.get_json_object(body, f"$.{n}").try_cast("int")
        loose = F.nullif(F.regexp_extract(reply, rf"(?i){n}\"?\s*[:：]\s*(\d)", 1), F.lit("")).cast("int")
        fields.append(F.coalesce(parsed, loose, F.lit(default)).alias(n))
    return F.struct(*fields)


def idf_weights(pairs: DataFrame) -> DataFrame:
    """(token, weight) of every token of the references: ln(N / (count + 1)), where N is the number of references and count how often the
    token occurs in them (occurrences, not texts). pairs: id, side ("p" or "r"), token. Counts are summed before they are shuffled."""
    refs = pairs.where("side = 'r'")
    total = refs.agg(F.count_distinct("id").alias("texts"))
    return refs.groupBy("token").agg(F.count("*").alias("n")).crossJoin(total).select("token", F.log(F.col("texts") / (F.col("n") + 1)).alias("weight"))


def token_similarity(pairs: DataFrame, vectors: DataFrame, weights: DataFrame | None = None, unknown: float = 1.0) -> DataFrame:
    """Precision, recall and F1 of token embeddings by id: each token's best cosine in the other text, averaged (by weight).

    pairs: id, side ("p" or "r"), token, a row for each occurrence; vectors: token, vector; weights: token, weight, `unknown` for tokens without one.
    A side whose weights sum to nothing or less has 0. Tokens that occur again in a text are compared once and count as often.
    """
    tok = pairs.groupBy("id", "side", "token").agg(F.count("*").cast("double").alias("weight")).join(vectors, "token")
    if weights is not None:
        tok = tok.join(weights.select("token", F.col("weight").alias("own")), "token", "left").withColumn("weight", F.col("weight") * F.coalesce("own", F.lit(unknown)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    unit = tok.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))
    p = unit.where("side = 'p'").select("id", F.col("token").alias("pt"), F.col("vector").alias("pv"), F.col("norm").alias("pn"), F.col("weight").alias("pw"))
    r = unit.where("side = 'r'").select("id", F.col("token").alias("rt"), F.col("vector").alias("rv"), F.col("norm").alias("rn"), F.col("weight").alias("rw"))
    both = p.join(r, "id").withColumn("cosine", dot(F.col("pv"), F.col("rv")) / F.nullif(F.col("pn") * F.col("rn"), F.lit(0.0)))

    def mean(token: str, weight: str, name: str) -> DataFrame:
        best = both.groupBy("id", token, weight).agg(F.max("cosine").alias("best")).groupBy("id")
        total = F.sum(weight)
        return best.agg(F.when(total > 0, F.sum(F.col("best") * F.col(weight)) / F.nullif(total, F.lit(0.0))).otherwise(0.0).alias(name))

    out, total = mean("pt", "pw", "precision").join(mean("rt", "rw", "recall"), "id"), F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))).otherwise(0.0))
