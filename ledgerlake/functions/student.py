"""Student's t tail as column expressions: the regularised incomplete beta function I_x(a, 1/2).

``I_x(a, b) = x^a (1-x)^b / (a B(a, b)) * K`` with the continued fraction K of DLMF 8.17.22, which settles after a
number of terms that grows with the root of the larger parameter where ``x < (a + 1) / (a + b + 2)``; elsewhere
``1 - I_(1-x)(b, a)``. A bounded ``aggregate`` evaluates the fraction from its tail inwards, so a row costs
about ``100 + 5 sqrt(a)`` steps and nothing leaves the JVM.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ln(G(a + 1/2) / G(a)) - ln(a) / 2 in powers of 1 / a: (power, coefficient), from Bernoulli numbers.
HALF_STEP = [(1, -1 / 8), (3, 1 / 192), (5, -1 / 640), (7, 17 / 14336), (9, -31 / 18432)]
#: The series is taken this far above ``a``; the recurrence of the gamma function leads back.
SHIFT = 12


def half_step(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)) for a > 0."""
    up = a + SHIFT
    series = reduce(lambda s, t: s + F.lit(t[1]) / F.pow(up, F.lit(float(t[0]))), HALF_STEP, F.ln(up) / 2)
    back = reduce(lambda p, j: p * ((a + j) / (a + j + 0.5)), range(SHIFT), F.lit(1.0))
    return series + F.ln(back)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of I_x(a, b), from its tail inwards."""
    last = (F.lit(100) + F.lit(5) * F.sqrt(F.greatest(a, b))).cast("int")

    def term(tail, i):
        m = i.cast("double")
        even = 1 - (a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1) * tail)
        odd = 1 + m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m) * even)
        return F.when(i > 0, odd).otherwise(even)
    return 1 / F.aggregate(F.sequence(last, F.lit(0)), F.lit(1.0), term)


def beta_half(a: Column, x: Column, rest: Column) -> Column:
    """I_x(a, 1/2) for a > 0; ``rest`` is 1 - x, given apart so that it keeps its digits."""
    half = F.lit(0.5)
    near = x < (a + 1) / (a + 2.5)
    front = F.exp(a * F.ln(x) + half * F.ln(rest) + half_step(a) - F.lit(math.log(math.pi) / 2))
    pick = lambda one, other: F.when(near, one).otherwise(other)
    value = front * _fraction(pick(a, half), pick(half, a), pick(x, rest)) / pick(a, half)
    return (F.when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0))
            .otherwise(F.when(near, value).otherwise(1 - value)))


def two_sided_p(r: Column, n: Column) -> Column:
    """P(|T| > |t|) of a correlation r over n pairs, t = r sqrt((n - 2) / (1 - r^2)); 1 where r is NULL or n < 3.

    With T of n - 2 degrees of freedom this is I_(1 - r^2)((n - 2) / 2, 1/2).
    """
    r2 = F.least(r * r, F.lit(1.0))
    free = (n - 2).cast("double") / 2
    # (1 - r)(1 + r) keeps the digits of 1 - r^2 for r near 1
    return (F.when(r.isNull() | F.isnan(r) | (n < 3), F.lit(1.0))
            .otherwise(beta_half(free, F.greatest((1 - F.abs(r)) * (1 + F.abs(r)), F.lit(0.0)), r2)))
