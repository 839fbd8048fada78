"""Queries of answer scoring and model comparison, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import arrow, score
from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.operators import evaluate
from lodestar.plans.base import frame, sql

# ---- the same rules as SQL text, written from the word lists


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _first(col: str, rules: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_any(col, w)} THEN '{k}'" for k, w in rules.items()) + " END"


def _word(col: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, '{w}') THEN '{w}'" for w in words) + " END"


def _direction(col: str) -> str:
    word = _word(col, T.longest_first(V.DIRECTIONS_20))
    return "CASE " + " ".join(f"WHEN ({word}) IN ({', '.join(repr(w) for w in g)}) THEN '{k}'" for k, g in V.DIRECTION_GROUPS.items()) + " END"


def _number(col: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({col}, '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE)"


def _unit(col: str) -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract({col}, '{p}', 1), '') AS DOUBLE) * {k}" for p, k in V.UNIT_PATTERNS) + ")"


def _near(p: str, r: str, share: float = 0.15) -> str:
    return f"coalesce(abs({p} - {r}) <= greatest({r} * {share}, 50.0), false)"


def _v2(p: str = "prediction", r: str = "reference", kind: str = "spatial_type") -> str:
    p, r = f"lower(trim({p}))", f"lower(trim({r}))"
    d, m = f"coalesce({_direction(p)} = {_direction(r)}, false)", _near(_number(p), _number(r))
    tp, tr = _first(p, V.TOPOLOGY_WORDS), _first(r, V.TOPOLOGY_WORDS)
    shared = "(" + " OR ".join(f"(contains({p}, '{w}') AND contains({r}, '{w}'))" for w in V.TOPOLOGY_CONFIGURED) + ")"
    t = f"CASE WHEN {tp} IS NULL OR {tr} IS NULL THEN {shared} ELSE {tp} = {tr} END"
    return f"CASE WHEN {p} = {r} THEN true WHEN {kind} = 'directional' THEN {d} WHEN {kind} = 'topological' THEN {t} WHEN {kind} = 'metric' THEN {m} ELSE {d} AND {m} END"


def _v1(p: str = "prediction", r: str = "reference") -> str:
    d = f"coalesce(({_word(p, V.DIRECTIONS_8)}) = ({_word(r, V.DIRECTIONS_8)}), false)"
    t = f"coalesce({_first(p, V.TOPOLOGY_WORDS_V1)} = {_first(r, V.TOPOLOGY_WORDS_V1)}, false)"
    m = _near(_unit(p), _unit(r), 0.10)
    return f"CASE spatial_type WHEN 'directional' THEN {d} WHEN 'topological' THEN {t} WHEN 'metric' THEN {m} ELSE {d} AND {m} END"


_FORMAT = r"(length(trim(prediction)) >= 2 AND NOT starts_with(trim(prediction), 'ERROR:') AND regexp_matches(prediction, '[\x{4e00}-\x{9fff}0-9]'))"
_SETS = "GROUP BY GROUPING SETS ((), (spatial_type), (difficulty))"
_SCOPE = "CASE WHEN grouping(spatial_type) = 0 THEN 'spatial_type' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS scope, CASE WHEN grouping(spatial_type) = 0 THEN spatial_type WHEN grouping(difficulty) = 0 THEN difficulty ELSE 'all' END AS grp"


def _tp(words: list[str]) -> str:
    return "(" + " + ".join(f"(contains(prediction, '{w}') AND contains(reference, '{w}'))::INT" for w in words) + ")"


def _size(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({col}, '{w}')::INT" for w in words) + ")"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "answers")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def ev_accuracy(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumns({"correct": score.correct_v2(F.col("spatial_type"), F.col("prediction"), F.col("reference")), "format_ok": score.format_valid(F.col("prediction"))})
    counts = {}
    for name, words in evaluate.FAMILIES.items():
        counts |= dict(zip((f"tp_{name}", f"fp_{name}", f"fn_{name}"), score.keyword_counts(F.col("prediction"), F.col("reference"), words), strict=True))
    rows = rows.withColumns(counts)
    rows = rows.withColumns({x: sum((F.col(f"{x}_{f}") for f in evaluate.FAMILIES), F.lit(0)) for x in ("tp", "fp", "fn")}).withColumn("bleu4", F.lit(0.0))
    return _rounded(evaluate.report(rows).drop("bleu4"), "accuracy", "format_rate", "keyword_f1")


def _accuracy_sql() -> str:
    words = [w for f in evaluate.FAMILIES.values() for w in f]
    tp, np_, nr = _tp(words), _size("prediction", words), _size("reference", words)
    return sql(
        f"""WITH s AS (SELECT spatial_type, difficulty, {_v2()} AS ok, {_FORMAT} AS fmt, {tp} AS tp, {np_} AS np, {nr} AS nr FROM answers)
        SELECT {_SCOPE}, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, round(avg(ok::INT), 6) AS accuracy, round(avg(fmt::INT), 6) AS format_rate,
        round(coalesce(2.0 * sum(tp) / nullif(sum(np) + sum(nr), 0), 0), 6) AS keyword_f1 FROM s {_SETS}""",
        "answers",
    )


def ev_accuracy_v1(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("ok", score.correct_v1(F.col("spatial_type"), F.col("prediction"), F.col("reference")))
    return rows.groupBy("spatial_type").agg(F.count("*").alias("total"), F.count_if("ok").alias("correct"))


def ev_bleu4(spark, sf_dir):
    p, r = F.col("prediction"), F.col("reference")
    rows = _answers(spark, sf_dir).select(
        "id", score.bleu(p, r).alias("bleu_v2"), score.bleu(p, r, smoothing=1e-10, strict_penalty=True).alias("bleu_v1"), score.bleu(p, r, order=1).alias("bleu_1")
    )
    return _rounded(rows, "bleu_v2", "bleu_v1", "bleu_1")


def _bleu_sql() -> str:
    grams = " UNION ALL ".join(
        f"SELECT id, {n} AS n, side, g, count(*) AS c FROM (SELECT id, side, substr(t, i, {n}) AS g FROM (SELECT id, side, t, unnest(range(1, greatest(length(t) - {n - 2}, 1)::BIGINT)) AS i FROM texts)) GROUP BY ALL" for n in range(1, 5)
    )
    return sql(
        f"""WITH texts AS (SELECT id, 'p' AS side, prediction AS t FROM answers UNION ALL SELECT id, 'r', reference FROM answers),
        grams AS ({grams}),
        hits AS (SELECT p.id, p.n, sum(least(p.c, coalesce(r.c, 0))) AS h, sum(p.c) AS total FROM (SELECT * FROM grams WHERE side = 'p') p LEFT JOIN (SELECT * FROM grams WHERE side = 'r') r ON p.id = r.id AND p.n = r.n AND p.g = r.g GROUP BY p.id, p.n),
        prec AS (SELECT a.id, k.n, coalesce(h.h / h.total, 0.0) AS p, length(prediction)::DOUBLE AS c, length(reference)::DOUBLE AS r FROM answers a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) k LEFT JOIN hits h ON h.id = a.id AND h.n = k.n)
        SELECT id,
        round(coalesce(CASE WHEN min(p) > 0 THEN exp(sum(ln(greatest(p, 1e-300))) / 4) * CASE WHEN any_value(c) <= any_value(r) THEN exp(1 - any_value(r) / nullif(any_value(c), 0)) ELSE 1 END END, 0), 6) AS bleu_v2,
        round(coalesce(exp(sum(ln(greatest(p, 1e-10))) / 4) * CASE WHEN any_value(c) < any_value(r) THEN exp(1 - any_value(r) / nullif(any_value(c), 0)) ELSE 1 END, 0), 6) AS bleu_v1,
        round(coalesce(max(CASE WHEN n = 1 THEN p END) * CASE WHEN any_value(c) <= any_value(r) THEN exp(1 - any_value(r) / nullif(any_value(c), 0)) ELSE 1 END, 0), 6) AS bleu_1
        FROM prec GROUP BY id""",
        "answers",
    )


def _bleu_groups_sql() -> str:
    rows = _bleu_sql()
    at = rows.rindex("SELECT id,\n")
    plain = """SELECT id, coalesce(CASE WHEN min(p) > 0 THEN exp(avg(ln(greatest(p, 1e-300)))) * CASE WHEN any_value(c) <= any_value(r) THEN exp(1 - any_value(r) / nullif(any_value(c), 0)) ELSE 1 END END, 0) AS v2,
        CASE WHEN min(p) > 0 THEN exp(avg(ln(greatest(p, 1e-300)))) ELSE avg(p) END AS v0 FROM prec GROUP BY id"""
    return f"{rows[:at].rstrip()}, per AS ({plain}) SELECT {_SCOPE}, count(*) AS total, round(avg(v2), 6) AS bleu4, round(avg(v0), 6) AS bleu_plain FROM answers JOIN per USING (id) {_SETS}"


def ev_rouge_l(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("rouge", arrow.rouge_l("prediction", "reference"))
    return _rounded(rows.groupBy("spatial_type").agg(F.count("*").alias("n"), F.avg("rouge").alias("rouge_l")), "rouge_l")


def ev_rouge_groups(spark, sf_dir):
    """ROUGE-L overall, by type and by difficulty, with its first version (1 where both texts are empty), in one aggregate."""
    texts = _answers(spark, sf_dir).withColumns({c: F.when(F.col("id") % 11 == 0, "").otherwise(F.coalesce(c, F.lit(""))) for c in ("prediction", "reference")})
    a = texts.withColumn("a", arrow.rouge_l("prediction", "reference")).withColumn("b", F.when((F.col("prediction") == "") & (F.col("reference") == ""), 1.0).otherwise(F.col("a")))
    out = a.groupingSets([[], [F.col("spatial_type")], [F.col("difficulty")]], F.col("spatial_type"), F.col("difficulty")).agg(F.grouping_id().alias("g"), F.count("*").alias("total"), F.round(F.avg("a"), 6).alias("rouge_l"), F.round(F.avg("b"), 6).alias("rouge_first"))
    scope = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "spatial_type").otherwise("difficulty")
    return out.select(scope.alias("scope"), F.coalesce("spatial_type", "difficulty", F.lit("all")).alias("grp"), "total", "rouge_l", "rouge_first")


def ev_keyword_f1_macro(spark, sf_dir):
    p, r = F.col("prediction"), F.col("reference")
    rows = _answers(spark, sf_dir).select("id", score.keyword_f1_macro(p, r, V.TOPOLOGY_DEFAULT).alias("topological"), score.keyword_f1_macro(p, r, V.DIRECTIONS_8).alias("directional"), score.keyword_f1_macro(p, r, V.METRIC_WORDS).alias("metric"))
    return _rounded(rows, "topological", "directional", "metric")


def _macro(words: list[str]) -> str:
    return f"round(CASE WHEN {_size('reference', words)} = 0 THEN 1 ELSE coalesce(2.0 * {_tp(words)} / nullif({_size('prediction', words)} + {_size('reference', words)}, 0), 0) END, 6)"


def ev_reasoning(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumns({"ok": score.reasoning_correct(F.col("prediction"), F.col("reference")), "runs": score.correct_by_runs(F.col("prediction"), F.col("reference"))})
    return rows.groupBy("spatial_type").agg(F.count_if("ok").alias("reasoning"), F.count_if("runs").alias("runs"))


_DIGITS = "list_sort(list_distinct(regexp_extract_all({}, '\\d+')))"


def ev_error_types(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("correct", score.correct_v2(F.col("spatial_type"), F.col("prediction"), F.col("reference")))
    return evaluate.errors(rows).groupBy("spatial_type", "difficulty", "cause").agg(F.count("*").alias("n"))


def _error_sql() -> str:
    p, r = "prediction", "reference"
    word = _word(p, T.longest_first(V.DIRECTIONS_20))
    d = f"CASE WHEN {word} IS NULL THEN 'direction_missing' WHEN NOT coalesce({_direction(p)} = {_direction(r)}, false) THEN 'direction_wrong' END"
    m = f"CASE WHEN {_number(p)} IS NULL THEN 'distance_missing' WHEN NOT {_near(_number(p), _number(r))} THEN 'distance_wrong' END"
    t = f"CASE WHEN {_first(p, V.TOPOLOGY_WORDS)} IS NULL THEN 'topology_missing' ELSE 'topology_wrong' END"
    cause = f"coalesce(nullif(CASE spatial_type WHEN 'directional' THEN {d} WHEN 'metric' THEN {m} WHEN 'topological' THEN {t} ELSE concat_ws('；', {d}, {m}) END, ''), 'other')"
    return sql(f"SELECT spatial_type, difficulty, {cause} AS cause, count(*) AS n FROM answers WHERE NOT ({_v2()}) GROUP BY ALL", "answers")


def ev_containment(spark, sf_dir):
    """Containment after final stops go, character overlap, and length change."""
    p, r = T.strip_stop(F.col("prediction")), T.strip_stop(F.col("reference"))
    chars = lambda c: F.array_distinct(F.split(c, ""))
    common = F.size(F.array_intersect(chars(p), chars(r)))
    rows = _answers(spark, sf_dir).select("spatial_type", F.contains(p, r).alias("ok"), (common / F.size(F.array_union(chars(p), chars(r)))).alias("alike"), (F.char_length(p) - F.char_length(r)).alias("longer"))
    return _rounded(rows.groupBy("spatial_type").agg(F.count_if("ok").alias("contained"), F.avg("alike").alias("alike"), F.avg("longer").alias("longer")), "alike", "longer")


def ev_agreement(spark, sf_dir):
    a = _answers(spark, sf_dir)
    long = a.select("id", F.lit("base").alias("model"), "prediction").union(a.select("id", F.lit("other").alias("model"), F.col("other"))).union(a.select("id", F.lit("truth").alias("model"), F.col("reference")))
    return _rounded(evaluate.agreement(long), "agreement")


def ev_head_to_head(spark, sf_dir):
    a = _answers(spark, sf_dir)
    one = a.withColumn("correct", score.correct_v2(F.col("spatial_type"), F.col("prediction"), F.col("reference")))
    two = a.withColumn("correct", score.correct_v2(F.col("spatial_type"), F.col("other"), F.col("reference")))
    return evaluate.head_to_head(one, two)


def ev_regression_study(spark, sf_dir):
    """Before and after by loose correctness: regressed, improved, both, neither, by type and difficulty."""
    k, r = F.col("spatial_type"), F.col("reference")
    before, after = F.coalesce(score.loosely_correct(k, F.col("prediction"), r), F.lit(False)), F.coalesce(score.loosely_correct(k, F.col("other"), r), F.lit(False))
    change = F.when(before & ~after, "regressed").when(~before & after, "improved").when(before, "both_right").otherwise("both_wrong")
    return _answers(spark, sf_dir).groupBy(k, "difficulty", change.alias("change")).agg(F.count("*").alias("n"))


def _loose_sql(p: str) -> str:
    p, r = f"lower(trim({p}))", "lower(trim(reference))"
    shared = "(" + " OR ".join(f"(contains({r}, '{w}') AND contains({p}, '{w}'))" for w in "东西南北") + ")"
    near = lambda s: f"coalesce(abs({_number(p)} - {_number(r)}) / nullif({_number(r)}, 0) <= {s}, false)"
    yes, no, by = (f"({_any(p, w)} AND {_any(r, w)})" for w in (["是", "位于", "属于"], ["否", "不"], ["相邻", "接壤"]))
    return f"CASE spatial_type WHEN 'directional' THEN {shared} WHEN 'metric' THEN {near(0.10)} WHEN 'composite' THEN {shared} AND {near(0.15)} WHEN 'topological' THEN {yes} OR {no} OR {by} ELSE false END"


def ev_tuning_study(spark, sf_dir):
    """Before and after by the study's correctness: regressed, improved, both, neither, by type and difficulty."""
    k, r = F.col("spatial_type"), F.col("reference")
    before, after = (F.coalesce(score.study_correct(k, F.col(c), r), F.lit(False)) for c in ("prediction", "other"))
    change = F.when(before & ~after, "regressed").when(~before & after, "improved").when(before, "both_right").otherwise("both_wrong")
    return _answers(spark, sf_dir).groupBy(k, "difficulty", change.alias("change")).agg(F.count("*").alias("n"))


def _study_sql(p: str) -> str:
    shared = lambda words: "(" + " OR ".join(f"(contains(reference, '{w}') AND contains({p}, '{w}'))" for w in words) + ")"
    near = f"(SELECT coalesce(bool_or(abs(a::BIGINT - b::BIGINT) < 50), false) FROM (SELECT unnest(regexp_extract_all(reference, '\\d+')) AS a), (SELECT unnest(regexp_extract_all({p}, '\\d+')) AS b))"
    return f"lower(trim({p})) = lower(trim(reference)) OR CASE spatial_type WHEN 'directional' THEN {shared('东西南北')} WHEN 'metric' THEN {near} WHEN 'topological' THEN {shared(['内部', '包含', '相邻', '独立', '交叉', '边界'])} ELSE false END"


def ev_bleu_groups(spark, sf_dir):
    """BLEU overall, by type and by difficulty, in one aggregate."""
    a = _answers(spark, sf_dir).withColumns({"a": score.bleu(F.col("prediction"), F.col("reference")), "b": score.bleu_plain(F.col("prediction"), F.col("reference"))})
    out = a.groupingSets([[], [F.col("spatial_type")], [F.col("difficulty")]], F.col("spatial_type"), F.col("difficulty")).agg(F.grouping_id().alias("g"), F.count("*").alias("total"), F.round(F.avg("a"), 6).alias("bleu4"), F.round(F.avg("b"), 6).alias("bleu_plain"))
    scope = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "spatial_type").otherwise("difficulty")
    return out.select(scope.alias("scope"), F.coalesce("spatial_type", "difficulty", F.lit("all")).alias("grp"), "total", "bleu4", "bleu_plain")


def ev_older_scorers(spark, sf_dir):
    """The earliest scorers and the first parser, row by row."""
    p, r, kind = F.col("prediction"), F.col("reference"), F.col("spatial_type")
    asked = F.when(kind == "directional", "direction").when(kind == "topological", "topology").when(kind == "metric", "distance").otherwise("auto")
    reply = F.when(F.col("id") % 5 == 0, F.concat(F.lit('```json\n{"answer": "'), p, F.lit('"}\n```'))).when(F.col("id") % 5 == 1, F.lit('so {"x": [1, 2]} it is')).when(F.col("id") % 5 == 2, F.lit("{no json}")).otherwise(p)
    return _answers(spark, sf_dir).select(
        "id", F.round(score.spatial_f1(p, r), 6).alias("spatial_f1"), score.direction_flexible(p, r).alias("flexible"), score.parsed_direction(p).alias("direction"),
        score.parsed_topology(p).alias("topology"), F.round(score.parsed_km(p), 6).alias("km"), score.parsed_match(asked, p, r).alias("matched"), score.answer_shown(reply).alias("shown"),
    )


def _older_sql() -> str:
    words = V.SPATIAL_WORDS
    tp, sp, sr = _tp(words), _size("prediction", words), _size("reference", words)
    strip = lambda c: f"regexp_replace(trim({c}), '[。.]+$', '')"
    word = _word("replace(fr, '方向', '')", V.FLEXIBLE_DIRECTIONS)
    longer = " OR ".join(f"(contains('{d}', w) AND contains(fp, '{d}'))" for d in V.FLEXIBLE_DIRECTIONS[:8])
    dirs = lambda c: _first(f"lower(trim({c}))", V.PARSER_DIRECTIONS)
    topo = lambda c: _first(f"lower(trim({c}))", V.PARSER_TOPOLOGY)
    km = lambda c: "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(lower({c}), '(\\d+(?:\\.\\d+)?)\\s*{u}', 1), '') AS DOUBLE) * {k}" for u, k in (("公里", 1), ("千米", 1), ("km", 1), ("米", 0.001), ("m", 0.001))) + ")"
    return sql(
        f"""WITH x AS (SELECT *, {tp} AS tp, {sp} AS sp, {sr} AS sr, {strip('prediction')} AS fp, {strip('reference')} AS fr, {dirs('prediction')} AS dp, {dirs('reference')} AS dr,
        {topo('prediction')} AS tpp, {topo('reference')} AS tr, {km('prediction')} AS kp, {km('reference')} AS kr FROM answers), y AS (SELECT *, {word} AS w,
        CASE spatial_type WHEN 'directional' THEN 'd' WHEN 'topological' THEN 't' WHEN 'metric' THEN 'm' ELSE CASE WHEN dr IS NOT NULL THEN 'd' WHEN tr IS NOT NULL THEN 't' WHEN kr > 0 THEN 'm' ELSE 'x' END END AS k FROM x)
        SELECT id, round(CASE WHEN sp + sr = 0 THEN 1.0 ELSE 2.0 * tp / (sp + sr) END, 6) AS spatial_f1,
        contains(fp, fr) OR coalesce(contains(fp, w) AND (length(w) = 2 OR NOT ({longer})), false) AS flexible, dp AS direction, tpp AS topology, round(kp, 6) AS km,
        coalesce(CASE k WHEN 'd' THEN dp = dr WHEN 't' THEN tpp = tr WHEN 'm' THEN kr > 0 AND kp > 0 AND abs(kp - kr) <= greatest(kr * 0.05, 1.0) ELSE lower(trim(prediction)) = lower(trim(reference)) END, false) AND length(prediction) > 0 AND length(reference) > 0 AS matched,
        id % 5 < 2 OR (id % 5 > 2 AND {_any('prediction', V.ANSWER_WORDS)}) AS shown FROM y""",
        "answers",
    )


def ev_default_answers(spark, sf_dir):
    """Most frequent answers by model, five each, with their share."""
    a = _answers(spark, sf_dir).groupBy("model", "prediction").agg(F.count("*").alias("n"))
    a = a.selectExpr("model", "prediction", "n", "row_number() over (partition by model order by n desc, prediction) as rank", "n / sum(n) over (partition by model) as share")
    return _rounded(a.where("rank <= 5"), "share")


def ev_direction_breakdown(spark, sf_dir):
    a = _answers(spark, sf_dir).where("spatial_type = 'directional'")
    r, p = (score.main_direction(F.col(c)) for c in ("reference", "prediction"))
    return a.groupBy(r.alias("direction")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(p == r, F.lit(False))).alias("right"), F.count_if(p != r).alias("wrong"), F.count_if(p.isNull()).alias("none"))


def ev_self_check(spark, sf_dir):
    a = _answers(spark, sf_dir)
    ok = score.correct_v2(F.col("spatial_type"), F.col("reference"), F.col("reference"))
    return a.agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"))


def ev_leaderboard(spark, sf_dir):
    a = _answers(spark, sf_dir).withColumn("ok", score.correct_v2(F.col("spatial_type"), F.col("prediction"), F.col("reference")))
    runs = a.groupBy("model").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"))
    return evaluate.leaderboard(runs, "accuracy")


def ev_metric_diff(spark, sf_dir):
    a = _answers(spark, sf_dir)
    acc = lambda c: a.groupBy("spatial_type").agg(F.avg(score.correct_v2(F.col("spatial_type"), F.col(c), F.col("reference")).cast("int")).alias("value"))
    return _rounded(evaluate.metric_diff(acc("prediction"), acc("other"), ["spatial_type"]), "a", "b", "difference", "relative")


def ev_judge_reply(spark, sf_dir):
    """Scores out of replies that hold JSON, loose text, or neither."""
    reply = F.when(F.col("id") % 3 == 0, F.concat(F.lit('结果 {"accuracy": '), (F.col("id") % 5 + 1).cast("string"), F.lit(', "clarity": 4}'))).when(F.col("id") % 3 == 1, F.concat(F.lit("accuracy: "), (F.col("id") % 5 + 1).cast("string"))).otherwise(F.lit("很好"))
    return _answers(spark, sf_dir).select("id", evaluate.judged(reply).alias("j")).select("id", "j.*")


def ev_token_similarity(spark, sf_dir):
    """Best-match similarity between two sides of texts of twenty tokens each, over all vectors."""
    e = frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"), F.floor(F.col("vec_id") / 20).alias("id"))
    pairs = e.select("id", F.when(F.col("token") % 2 == 0, "p").otherwise("r").alias("side"), "token")
    return _rounded(evaluate.token_similarity(pairs, e.select("token", "vector")), "precision", "recall", "f1")


def ev_idf_similarity(spark, sf_dir):
    """The same by idf of the reference side, over texts that share tokens: mean over all texts."""
    e = frame(spark, sf_dir, "embeddings")
    token = F.col("vec_id") - F.col("vec_id") % 3
    pairs = e.select(F.floor(F.col("vec_id") / 20).alias("id"), F.when(F.col("vec_id") % 2 == 0, "p").otherwise("r").alias("side"), token.alias("token"))
    vectors = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    own = evaluate.token_similarity(pairs, vectors, evaluate.idf_weights(pairs), unknown=0.0)
    return _rounded(own.agg(F.count("*").alias("n"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall")), "precision", "recall")


QUERIES = {
    f.__name__: f
    for f in (
        ev_rouge_groups, ev_idf_similarity, ev_accuracy, ev_accuracy_v1, ev_bleu4, ev_rouge_l, ev_keyword_f1_macro, ev_reasoning, ev_error_types, ev_containment, ev_agreement, ev_head_to_head,
        ev_regression_study, ev_tuning_study, ev_bleu_groups, ev_older_scorers, ev_default_answers, ev_direction_breakdown, ev_self_check, ev_leaderboard, ev_metric_diff, ev_judge_reply, ev_token_similarity,
    )
}

_OK = lambda p: _v2(p)
#: The longest common subsequence of distinct pairs of texts, a row of the table for each character of the first, by a recursive query.
_LCS = """texts AS (SELECT *, {p} AS p, {r} AS r FROM answers), distinct_pairs AS (SELECT DISTINCT p, r FROM texts),
        walk AS (SELECT p, r, 0 AS i, list_transform(range(length(r) + 1), lambda j: 0) AS held FROM distinct_pairs
          UNION ALL SELECT p, r, i + 1, list_transform(range(1, length(r) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE list_max(list_transform(range(2, j + 1), lambda k: CASE WHEN substr(r, k - 1, 1) = substr(p, i + 1, 1) THEN held[k - 1] + 1 ELSE held[k] END)) END) FROM walk WHERE i < length(p)),
        lcs AS (SELECT p, r, list_max(held) AS n FROM walk WHERE i = length(p)),
        rouge AS (SELECT t.*, CASE WHEN n > 0 THEN 2.0 * n / (length(t.p) + length(t.r)) ELSE 0 END AS f FROM texts t JOIN lcs USING (p, r))"""
ORACLES = {
    "ev_accuracy": _accuracy_sql(),
    "ev_accuracy_v1": sql(f"SELECT spatial_type, count(*) AS total, count(*) FILTER (WHERE {_v1()}) AS correct FROM answers GROUP BY ALL", "answers"),
    "ev_bleu4": _bleu_sql(),
    "ev_keyword_f1_macro": sql(f"SELECT id, {_macro(V.TOPOLOGY_DEFAULT)} AS topological, {_macro(V.DIRECTIONS_8)} AS directional, {_macro(V.METRIC_WORDS)} AS metric FROM answers", "answers"),
    "ev_reasoning": sql(
        f"""SELECT spatial_type, count(*) FILTER (WHERE trim(prediction) = trim(reference) OR contains(trim(prediction), trim(reference))
        OR (len({_DIGITS.format('reference')}) > 0 AND {_DIGITS.format('prediction')} = {_DIGITS.format('reference')})
        OR {' OR '.join(f"(contains(prediction, '{w}') AND contains(reference, '{w}'))" for w in V.DIRECTIONS_8)}) AS reasoning,
        count(*) FILTER (WHERE list_has_any(regexp_extract_all(prediction, '[\\x{{4e00}}-\\x{{9fff}}]+'), regexp_extract_all(reference, '[\\x{{4e00}}-\\x{{9fff}}]+'))) AS runs
        FROM answers GROUP BY ALL""", "answers"),
    "ev_error_types": _error_sql(),
    "ev_containment": sql(
        """WITH s AS (SELECT spatial_type, regexp_replace(prediction, '[。.]+$', '') AS p, regexp_replace(reference, '[。.]+$', '') AS r FROM answers),
        c AS (SELECT *, list_distinct(string_split(p, '')) AS a, list_distinct(string_split(r, '')) AS b FROM s)
        SELECT spatial_type, count(*) FILTER (WHERE contains(p, r)) AS contained, round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) AS alike, round(avg(length(p) - length(r)), 6) AS longer FROM c GROUP BY ALL""", "answers"),
    "ev_agreement": sql(
        """WITH l AS (SELECT id, 'base' AS model, prediction AS x FROM answers UNION ALL SELECT id, 'other', other FROM answers UNION ALL SELECT id, 'truth', reference FROM answers)
        SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, round(avg((trim(a.x) IS NOT DISTINCT FROM trim(b.x))::INT), 6) AS agreement FROM l a JOIN l b USING (id) WHERE a.model < b.model GROUP BY ALL""", "answers"),
    "ev_head_to_head": sql(
        f"""WITH s AS (SELECT spatial_type, difficulty, {_OK('prediction')} AS a, {_OK('other')} AS b FROM answers)
        SELECT {_SCOPE}, count(*) FILTER (WHERE a AND NOT b) AS only_one, count(*) FILTER (WHERE b AND NOT a) AS only_two, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM s {_SETS}""", "answers"),
    "ev_regression_study": sql(
        f"""WITH s AS (SELECT spatial_type, difficulty, coalesce({_loose_sql('prediction')}, false) AS a, coalesce({_loose_sql('other')}, false) AS b FROM answers)
        SELECT spatial_type, difficulty, CASE WHEN a AND NOT b THEN 'regressed' WHEN b AND NOT a THEN 'improved' WHEN a THEN 'both_right' ELSE 'both_wrong' END AS change, count(*) AS n FROM s GROUP BY ALL""", "answers"),
    "ev_tuning_study": sql(
        f"""WITH s AS (SELECT spatial_type, difficulty, coalesce({_study_sql('prediction')}, false) AS a, coalesce({_study_sql('other')}, false) AS b FROM answers)
        SELECT spatial_type, difficulty, CASE WHEN a AND NOT b THEN 'regressed' WHEN b AND NOT a THEN 'improved' WHEN a THEN 'both_right' ELSE 'both_wrong' END AS change, count(*) AS n FROM s GROUP BY ALL""", "answers"),
    "ev_bleu_groups": _bleu_groups_sql(),
    "ev_older_scorers": _older_sql(),
    "ev_default_answers": sql(
        """WITH c AS (SELECT model, prediction, count(*) AS n FROM answers GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, prediction) AS rank, round(n / sum(n) OVER (PARTITION BY model), 6) AS share FROM c)
        SELECT * FROM r WHERE rank <= 5""", "answers"),
    "ev_direction_breakdown": sql(
        f"""WITH s AS (SELECT {_direction('reference')} AS r, {_direction('prediction')} AS p FROM answers WHERE spatial_type = 'directional')
        SELECT r AS direction, count(*) AS n, count(*) FILTER (WHERE p = r) AS right, count(*) FILTER (WHERE p <> r) AS wrong, count(*) FILTER (WHERE p IS NULL) AS none FROM s GROUP BY r""", "answers"),
    "ev_self_check": sql(f"SELECT count(*) AS n, count(*) FILTER (WHERE {_v2('reference')}) AS correct FROM answers", "answers"),
    "ev_leaderboard": sql(f"WITH s AS (SELECT model, round(avg(({_v2()})::INT), 6) AS accuracy FROM answers GROUP BY model) SELECT *, rank() OVER (ORDER BY accuracy DESC) AS rank FROM s", "answers"),
    "ev_metric_diff": sql(
        f"""WITH s AS (SELECT spatial_type, avg(({_OK('prediction')})::INT) AS a, avg(({_OK('other')})::INT) AS b FROM answers GROUP BY ALL)
        SELECT spatial_type, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS difference, round((b - a) / nullif(abs(a), 0), 6) AS relative FROM s""", "answers"),
    "ev_judge_reply": sql("SELECT id, CASE WHEN id % 3 < 2 THEN id % 5 + 1 ELSE 3 END AS accuracy, 3 AS completeness, CASE WHEN id % 3 = 0 THEN 4 ELSE 3 END AS clarity FROM answers", "answers"),
    "ev_rouge_l": sql("WITH " + _LCS.format(p="prediction", r="reference") + """ SELECT spatial_type, count(*) AS n, round(avg(f), 6) AS rouge_l FROM rouge GROUP BY 1""", "answers").replace("WITH ", "WITH RECURSIVE ", 1),
    "ev_rouge_groups": sql("WITH " + _LCS.format(p="CASE WHEN id % 11 = 0 THEN '' ELSE coalesce(prediction, '') END", r="CASE WHEN id % 11 = 0 THEN '' ELSE coalesce(reference, '') END") + """
        SELECT CASE WHEN grouping(spatial_type) = 0 THEN 'spatial_type' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS scope, coalesce(spatial_type, difficulty, 'all') AS grp, count(*) AS total,
        round(avg(f), 6) AS rouge_l, round(avg(CASE WHEN p = '' AND r = '' THEN 1 ELSE f END), 6) AS rouge_first FROM rouge GROUP BY GROUPING SETS ((), (spatial_type), (difficulty))""", "answers").replace("WITH ", "WITH RECURSIVE ", 1),
    "ev_idf_similarity": """WITH t AS (SELECT vec_id // 20 AS id, vec_id % 2 = 0 AS p, vec_id - vec_id % 3 AS token FROM embeddings), v AS (SELECT vec_id AS token, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 = 0),
        w AS (SELECT token, ln((SELECT count(DISTINCT id) FROM t WHERE NOT p) / (count(*) + 1)) AS w FROM t WHERE NOT p GROUP BY token),
        k AS (SELECT id, p, token, v, coalesce(w, 0) AS w FROM t JOIN v USING (token) LEFT JOIN w USING (token)), d AS (SELECT DISTINCT id, p, token, v FROM k),
        c AS (SELECT x.id, x.token AS pt, y.token AS rt, list_cosine_similarity(x.v, y.v) AS s FROM d x JOIN d y ON x.id = y.id AND x.p AND NOT y.p),
        bp AS (SELECT id, pt AS token, max(s) AS s FROM c GROUP BY ALL), br AS (SELECT id, rt AS token, max(s) AS s FROM c GROUP BY ALL),
        a AS (SELECT k.id, CASE WHEN sum(w) > 0 THEN sum(w * s) / sum(w) ELSE 0 END AS m FROM k JOIN bp USING (id, token) WHERE p GROUP BY k.id), b AS (SELECT k.id, CASE WHEN sum(w) > 0 THEN sum(w * s) / sum(w) ELSE 0 END AS m FROM k JOIN br USING (id, token) WHERE NOT p GROUP BY k.id)
        SELECT count(*) AS n, round(avg(a.m), 6) AS precision, round(avg(b.m), 6) AS recall FROM a JOIN b USING (id)""",
    "ev_token_similarity": """WITH t AS (SELECT vec_id // 20 AS id, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        c AS (SELECT p.id, p.vec_id AS pt, r.vec_id AS rt, list_cosine_similarity(p.v, r.v) AS s FROM t p JOIN t r ON p.id = r.id AND p.vec_id % 2 = 0 AND r.vec_id % 2 = 1),
        a AS (SELECT id, avg(m) AS p FROM (SELECT id, pt, max(s) AS m FROM c GROUP BY ALL) GROUP BY id), b AS (SELECT id, avg(m) AS r FROM (SELECT id, rt, max(s) AS m FROM c GROUP BY ALL) GROUP BY id)
        SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM a JOIN b USING (id)""",
}
