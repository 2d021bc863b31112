"""Standard normal distribution as native column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational coefficients for the normal tail, as printed in
# G. West, "Better approximations to cumulative normal functions" (2005).
TAIL_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
TAIL_END = 37.0
SQRT_TWO_PI = 2.506628274631

# Tabulated two-sided critical values, and the coefficients of
# Abramowitz and Stegun 26.2.23 for every other alpha.
TABULATED_CRITICAL = {0.05: 1.96, 0.01: 2.576}
PROBIT_NUMERATOR = (2.515517, 0.802853, 0.010328)
PROBIT_DENOMINATOR = (1.0, 1.432788, 0.189269, 0.001308)
TABULATED_TOLERANCE = 1e-6


def _horner(x: Column, coefficients) -> Column:
    first, *rest = (F.lit(c) for c in coefficients)
    return reduce(lambda acc, c: acc * x + c, rest, first)


def upper_tail(z: Column) -> Column:
    """P(Z > |z|). Pass a named column: the expression mentions ``z`` many times."""
    a = F.abs(z)
    density = F.exp(-a * a / 2.0)
    near = density * _horner(a, TAIL_NUMERATOR) / _horner(a, TAIL_DENOMINATOR)
    fraction = reduce(lambda acc, k: a + F.lit(float(k)) / acc, (4, 3, 2, 1), a + 0.65)
    far = density / fraction / SQRT_TWO_PI
    return F.when(a < TAIL_SWITCH, near).when(a < TAIL_END, far).otherwise(a * 0.0)


def two_sided_p(z: Column) -> Column:
    return upper_tail(z) * 2.0


def normal_cdf(z: Column) -> Column:
    return F.when(z > 0, 1.0 - upper_tail(z)).otherwise(upper_tail(z))


def _check_alpha(alpha: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, got {alpha}")


def critical_value(alpha: float) -> float:
    """Two-sided critical value for a literal alpha, worked out once on the driver."""
    _check_alpha(alpha)
    tail = alpha / 2
    for listed, z in TABULATED_CRITICAL.items():
        if abs(tail - listed / 2) < TABULATED_TOLERANCE:
            return z
    t = math.sqrt(-2 * math.log(tail))
    top = sum(c * t**i for i, c in enumerate(PROBIT_NUMERATOR))
    bottom = sum(c * t**i for i, c in enumerate(PROBIT_DENOMINATOR))
    return t - top / bottom


def critical_value_of(alpha: Column) -> Column:
    """The same critical value where alpha is a column; NULL outside (0, 1)."""
    tail = alpha / 2.0
    t = F.sqrt(-2.0 * F.log(tail))
    top = _horner(t, reversed(PROBIT_NUMERATOR))
    bottom = _horner(t, reversed(PROBIT_DENOMINATOR))
    picked = F.when((alpha <= 0) | (alpha >= 1), F.lit(None).cast("double"))
    for listed, z in TABULATED_CRITICAL.items():
        picked = picked.when(F.abs(tail - listed / 2) < TABULATED_TOLERANCE, F.lit(z))
    return picked.otherwise(t - top / bottom)
