"""Special functions as Columns: log-gamma, the incomplete beta function, and the p-value of a correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.let import let

# fixed values: coefficients of Stirling's series, B(2k) / (2k (2k - 1))
_STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number: Stirling's series eight steps up, and back by the recurrence."""

    def at(y: Column) -> Column:
        series = F.lit(0.0)
        for c in reversed(_STIRLING):
            series = series / (y * y) + c
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series / y

    steps = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, k: s + F.log(x + k))
    return let(x + 8.0, at) - steps


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function from its front, by ratios of successive convergents; as many terms as its
    convergence needs. On the side where it is used no denominator comes near zero."""
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def term(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.when(j % 2 == 0, even).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    def step(s: Column, j: Column) -> Column:
        ratios = let(term(j), lambda t: F.struct((1 + t / s["c"]).alias("c"), (1 / (1 + t * s["d"])).alias("d")))
        return let(ratios, lambda r: state(r["c"], r["d"], s["h"] * r["c"] * r["d"]))

    first = 1 / (1 - (a + b) * x / (a + 1))
    terms = F.sequence(F.lit(2), F.ceil(120 + 8 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(terms, state(F.lit(1.0), first, first), step)["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of a, b > 0 at x from 0 to 1."""
    low = x < (a + 1) / (a + b + 2)
    # the fraction converges fast on the lower side only, so the upper one is taken from the other end
    sides = F.struct(F.when(low, a).otherwise(b).alias("p"), F.when(low, b).otherwise(a).alias("q"), F.when(low, x).otherwise(1 - x).alias("y"))

    def part(s: Column) -> Column:
        p, q, y = s["p"], s["q"], s["y"]
        return F.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * F.log(y) + q * F.log(1 - y)) * _fraction(p, q, y) / p

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(low, let(sides, part)).otherwise(1 - let(sides, part))


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided p-value of a correlation r of n pairs, from Student's distribution with n - 2 degrees of freedom; null for n < 3."""
    return F.when(n >= 3, incomplete_beta((n - 2).cast("double") / 2, F.lit(0.5), F.greatest(F.lit(0.0), 1 - r * r)))
