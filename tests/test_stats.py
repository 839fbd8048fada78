"""Special functions against closed forms and numerical integration; common subsequences against the plain table; weighted similarity."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import arrow, stats
from lodestar.operators import evaluate


def test_lgamma_and_incomplete_beta(spark):
    xs = [1e-3, 0.5, 1.0, 1.5, 2.0, 10.0, 123.25, 1e4, 5e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.lgamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-13, abs=1e-12) for r in got)
    cases = [(1.0, 1.0, 0.3), (2.0, 3.0, 0.4), (5.0, 1.0, 0.9), (0.5, 0.5, 0.25), (3.0, 7.0, 0.95), (2.0, 2.0, 0.0), (2.0, 2.0, 1.0)]
    closed = lambda a, b, x: 2 / math.pi * math.asin(math.sqrt(x)) if a == 0.5 else sum(math.comb(int(a + b - 1), j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(int(a), int(a + b)))
    got = spark.createDataFrame(cases, "a double, b double, x double").select("*", stats.incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("i")).collect()
    assert all(r.i == pytest.approx(closed(r.a, r.b, r.x), abs=1e-12) for r in got)


def test_p_values_of_correlations(spark):
    def integral(r, n, steps=200_000):  # Simpson's rule over the density of r without correlation
        a, low, h = (n - 2) / 2, abs(r), (1 - abs(r)) / steps
        total = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * 2 * (1 - (low + i * h) ** 2) ** (a - 1) for i in range(steps + 1))
        return total * h / 3 * math.exp(math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5))

    cases = [(0.5, 10), (-0.3, 40), (0.05, 1000), (0.0, 50), (0.99, 6), (0.01, 60_000)]
    got = spark.createDataFrame([*cases, (1.0, 20), (0.4, 2)], "r double, n long").select("r", "n", stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for (r, n), row in zip(cases, got, strict=False):
        assert row.p == pytest.approx(integral(r, n), abs=1e-9)
    assert got[-2].p == 0 and got[-1].p is None
    assert got[0].p == pytest.approx(0.141113, abs=1e-6)


def test_common_subsequences_of_any_length(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(2)
    pairs = [("".join(rng.choice("ab城市𝄞") for _ in range(rng.randint(0, n))), "".join(rng.choice("ab城市c") for _ in range(rng.randint(0, n)))) for n in (3, 10, 70, 300) for _ in range(60)]
    assert all(arrow._lcs(a, b) == plain(a, b) == arrow._lcs(b, a) for a, b in pairs)


def test_idf_weights_count_occurrences(spark):
    pairs = spark.createDataFrame([(1, "r", "a"), (1, "r", "a"), (1, "r", "b"), (1, "p", "a"), (1, "p", "c"), (2, "r", "c"), (2, "p", "c"), (2, "p", "c"), (3, "r", "d"), (3, "p", "b")], "id int, side string, token string")
    weights = {r.token: r.weight for r in evaluate.idf_weights(pairs).collect()}
    assert weights == pytest.approx({"a": math.log(3 / 3), "b": math.log(3 / 2), "c": math.log(3 / 2), "d": math.log(3 / 2)})
    vectors = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.6, 0.8], "d": [0.0, 0.0]}
    got = {r.id: r for r in evaluate.token_similarity(pairs, spark.createDataFrame(list(vectors.items()), "token string, vector array<double>"), evaluate.idf_weights(pairs), unknown=0.0).collect()}
    assert (got[1].precision, got[1].recall) == pytest.approx((1.0 * 0 + 0.8, 0.8)) and (got[2].precision, got[2].recall) == pytest.approx((1.0, 1.0))
    plain = {r.id: r for r in evaluate.token_similarity(pairs, spark.createDataFrame(list(vectors.items()), "token string, vector array<double>")).collect()}
    assert plain[1].recall == pytest.approx((1 + 1 + 0.8) / 3) and plain[2].precision == 1.0
