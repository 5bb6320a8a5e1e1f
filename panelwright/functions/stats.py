"""Statistical expressions that stay inside Catalyst."""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

from pyspark.sql import Column, functions as F

from panelwright.functions.scalar import col, divide

# Fixed value: above this |r| a correlation has no usable p-value.
VALID_CORRELATION_BOUND = 1.0 - 1e-6


def correlation(x, y) -> Column:
    """Pearson correlation aggregate, NULL when either side is constant.

    The built-in ``corr`` divides by zero on a constant group under ANSI mode.
    Both sides must be non-NULL together; see :func:`pairwise_correlation`.
    """
    x, y = col(x), col(y)
    return divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pairwise_correlation(x, y) -> Column:
    """Pearson correlation over the rows where both sides are present."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    return correlation(F.when(both, x), F.when(both, y))


def centred_correlation(x, y) -> Column:
    """Pearson correlation of values that already have mean zero."""
    x, y = col(x), col(y)
    return divide(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y)))


def share(condition: Column) -> Column:
    """Fraction of rows meeting ``condition``; NULL conditions count as not met."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def ratio_or(default: float | None, numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``default``."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default).cast("double"))


#: Steps of the continued fraction; with these it is within 1e-9 for 3 to ten million pairs.
FRACTION_STEPS = 30
# The series of gamma(z + 1/2) / gamma(z) / sqrt(z) in powers of 1 / z.
GAMMA_SERIES = (1, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): the series sixteen places further on, brought back by the recurrence."""
    back = reduce(mul, [(a + k) / (a + k + 0.5) for k in range(16)])
    z = a + 16
    return back * F.sqrt(z) * reduce(lambda total, c: total / z + c, reversed(GAMMA_SERIES), F.lit(0.0))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, a fixed number of steps from the front."""
    first = F.lit(1.0) / (F.lit(1.0) - (a + b) * x / (a + 1))

    def half(acc: Column, factor: Column) -> Column:
        d = F.lit(1.0) / (F.lit(1.0) + factor * acc["d"])
        c = F.lit(1.0) + factor / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    def step(acc: Column, m: Column) -> Column:
        even = half(acc, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return half(even, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    steps = F.array(*[F.lit(float(m)) for m in range(1, FRACTION_STEPS + 1)])
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda acc: acc["h"])


def correlation_p_value(r, n) -> Column:
    """Two-sided t-test p-value of a correlation ``r`` on ``n`` pairs.

    It is the incomplete beta function of 1 - r * r at (n - 2) / 2 and 1/2, of which
    the side is taken on which the fraction converges fast; the work does not grow with
    n.  NULL when r is NULL, |r| is practically 1, or n <= 2.
    """
    r = col(r)
    usable = r.isNotNull() & (F.abs(r) < VALID_CORRELATION_BOUND) & (col(n) > 2)
    r, n = F.when(usable, r), F.when(usable, col(n).cast("double"))
    a, half = (n - 2) / 2, F.lit(0.5)
    y = r * r
    x = F.lit(1.0) - y
    direct = x < (a + 1) / (a + 2.5)
    either = lambda p, q: F.when(direct, p).otherwise(q)
    front = F.exp(a * F.log1p(-y)) * F.abs(r) * _gamma_ratio(a) / math.sqrt(math.pi)
    # bound once, so that the steps do not work out their arguments anew
    given = F.array(F.struct(either(a, half).alias("a"), either(half, a).alias("b"), either(x, y).alias("x")))
    fraction = F.transform(given, lambda g: _beta_fraction(g["a"], g["b"], g["x"]))[0]
    part = front * fraction / either(a, half)
    return F.when(usable, F.greatest(F.lit(0.0), either(part, F.lit(1.0) - part)))
