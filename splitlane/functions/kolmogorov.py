"""Tail of the Kolmogorov distribution as a native column expression."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Both series converge fast on their side of this value: four terms are exact to 1e-15.
SWITCH = 1.2
TERMS = 4


def kolmogorov_tail(x: Column) -> Column:
    """P(sup |B(t)| >= x) of a Brownian bridge; 1 for x <= 0, NULL for NULL.

    The limit of the two-sample test and of a cumulative-sum test without a change. Small
    values use the theta series of the distribution, large ones that of its tail.
    """
    below = reduce(
        lambda a, b: a + b,
        [F.exp(-((2 * k - 1) ** 2) * math.pi**2 / 8.0 / (x * x)) for k in range(1, TERMS + 1)],
    )
    beyond = reduce(
        lambda a, b: a + b,
        [(-1.0) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, TERMS + 1)],
    )
    return F.when(x <= 0, F.lit(1.0)).when(x < SWITCH, 1.0 - math.sqrt(2 * math.pi) / x * below).otherwise(
        2.0 * beyond
    )
