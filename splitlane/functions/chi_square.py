"""Chi-square tail as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitlane.functions.normal import upper_tail

SQRT_PI = math.sqrt(math.pi)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X >= x) for ``df`` whole degrees of freedom: the upper regularized gamma function.

    For whole degrees of freedom it is a finite sum, each term the one before times
    ``x / 2`` over a growing number. An even count starts from an exponential, an odd
    one from the normal tail. Terms carry the exponential with them as a logarithm, so
    that large ``x`` underflows to 0 and not before. NULL for NULL, for fewer than one
    degree of freedom, and for NaN; 1 for x <= 0.
    """
    half = x / 2.0
    odd = df % 2 == 1
    # term j is half^(j + s) exp(-half) / gamma(j + s + 1), with s = 1/2 for odd counts, else 0
    log_half = F.log(half)
    steps = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")

    def add(state: Column, j: Column) -> Column:
        rank = j.cast("double") + F.when(odd, 0.5).otherwise(0.0)
        log_term = F.when(j == 0, state["log_term"]).otherwise(state["log_term"] + log_half - F.log(rank))
        return F.struct((state["total"] + F.exp(log_term)).alias("total"), log_term.alias("log_term"))

    first = F.when(odd, 0.5 * log_half - half - math.log(SQRT_PI / 2)).otherwise(-half)
    start = F.struct(F.lit(0.0).alias("total"), first.alias("log_term"))
    places = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(places, start, add, lambda s: s["total"])
    base = F.when(odd, 2.0 * upper_tail(F.sqrt(x))).otherwise(F.lit(0.0))
    usable = df.isNotNull() & (df >= 1) & x.isNotNull() & ~F.isnan(x)
    return F.when(usable & (x <= 0), F.lit(1.0)).when(usable, F.least(F.lit(1.0), base + total))
