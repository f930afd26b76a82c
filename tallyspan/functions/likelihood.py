"""The binomial mixture over multiplicities as Catalyst expressions: no Python runs per row.

alt of depth reads show a variant that is carried by m of total copies, m = 1..major with equal prior, in a fraction cp of
cells: the chance of a read is min(1, cp * m / denominator), denominator = 2 (1 - purity) + purity * total.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def let(value: Column, then) -> Column:
    """then(value) with value computed once a row, however often then uses it. Spark would put a copy at each use."""
    return F.transform(F.array(value), then)[0]


def lgamma(z: Column) -> Column:
    """ln of the gamma function for z >= 1: Stirling's series eight places on, and the product back. Good to 1e-12."""
    z = z.cast("double")
    y = z + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    back = F.ln(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def xlogy(x: Column, y: Column) -> Column:
    """x ln y, 0 where x is 0, minus infinity where only y is. Spark's own ln(0) is null."""
    return F.when(x == 0, 0.0).when(y <= 0, -_INF).otherwise(x * F.ln(y))


def xlog1my(x: Column, y: Column) -> Column:
    """x ln(1 - y) with the same limits."""
    return F.when(x == 0, 0.0).when(y >= 1, -_INF).otherwise(x * F.log1p(-y))


def denominator(total: Column, purity: float) -> Column:
    return F.lit(2 * (1 - purity)) + F.lit(purity) * total


def constant(alt: Column, depth: Column, major: Column) -> Column:
    """ln of the binomial coefficient, less ln major for the prior. Worth a column of its own before observations meet a grid."""
    return lgamma(depth + 1) - lgamma(alt + 1) - lgamma(depth - alt + 1) - F.ln(major.cast("double"))


def kernel(alt: Column, depth: Column, major: Column, den: Column, const: Column, cp: Column) -> Column:
    """Array over m = 1..major of the log likelihood of m at cp."""

    def at(m: Column) -> Column:
        return let(F.least(F.lit(1.0), cp * (m / den)), lambda p: xlogy(alt, p) + xlog1my(depth - alt, p) + const)

    return F.transform(F.sequence(F.lit(1), major.cast("int")), at)


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array; minus infinity if all are."""

    def over(v: Column, top: Column) -> Column:
        return F.when(top == -_INF, -_INF).otherwise(top + F.ln(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))))

    return let(values, lambda v: let(F.array_max(v), lambda top: over(v, top)))


def posterior(values: Column) -> Column:
    """Shares of the array's exponentials; null if none is finite."""
    return let(values, lambda v: let(log_sum_exp(v), lambda total: F.when(total > -_INF, F.transform(v, lambda x: F.exp(x - total)))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def modal(shares: Column) -> Column:
    """The likeliest m, the smallest if tied."""
    return let(shares, lambda s: F.array_position(s, F.array_max(s)).cast("long"))


def expected(shares: Column) -> Column:
    return F.aggregate(F.transform(shares, lambda p, i: p * (i + 1)), F.lit(0.0), lambda s, v: s + v)


def entropy(shares: Column) -> Column:
    return -F.aggregate(F.transform(shares, lambda p: xlogy(p, p)), F.lit(0.0), lambda s, v: s + v)
