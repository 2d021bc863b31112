"""Lift adjusted for several segment columns at once, by least squares in one pass.

The regression needs only sums of products of the columns, so one aggregation over the
rows, combined before its single shuffle, gives a small square matrix; the normal equations
are solved on the driver. Its size is that of the levels, whatever the traffic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.functions.normal import critical_value, two_sided_p
from splitlane.operators.diagnostics import new_or_returning
from splitlane.sources.contract import VARIANTS, EventTables

#: Levels that all segment columns may have together.
MOST_LEVELS = 60
RESULT = {"term": "string", "estimate": "double", "std_error": "double", "rows": "bigint", "reason": "string"}


def _levels(rows: DataFrame, segments: Sequence[str]) -> list[tuple[str, str]]:
    """Every segment column's levels but its first, as text; a missing value is a level."""
    named = [F.struct(F.lit(s).alias("segment"), F.coalesce(F.col(s).cast("string"), F.lit("(none)")).alias("level")) for s in segments]
    found = rows.select(F.inline(F.array(*named))).distinct().limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"the segment columns have more than {MOST_LEVELS} levels together")
    by: dict[str, list[str]] = {}
    for row in found:
        by.setdefault(row["segment"], []).append(row["level"])
    return [(s, level) for s in segments for level in sorted(by.get(s, []))[1:]]


def adjusted_lift(rows: DataFrame, outcome: str, segments: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Coefficients of ``outcome`` on treatment and the levels of ``segments``.

    ``rows`` has ``variant``; other variants and rows without an outcome do not count. One row per
    term: ``(intercept)``, ``treatment``, and ``<column>=<level>`` against the column's first level. A
    level that others already determine gets no estimate, only a ``reason``; so does every
    term where there are too few rows for a variance.
    """
    used = rows.where(F.col("variant").isin(*VARIANTS) & F.col(outcome).isNotNull())
    levels = _levels(used, segments) if segments else []
    columns: list[tuple[str, Column]] = [
        ("(intercept)", F.lit(1.0)),
        ("treatment", (F.col("variant") == "treatment").cast("double")),
    ]
    for s, level in levels:
        value = F.coalesce(F.col(s).cast("string"), F.lit("(none)"))
        columns.append((f"{s}={level}", (value == level).cast("double")))
    p, y = len(columns), F.col(outcome).cast("double")
    wide = used.select(y.alias("y"), *[c.alias(f"x{i}") for i, (_, c) in enumerate(columns)])
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(p)]
    row = wide.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *sums).head()
    spark, terms, n = rows.sparkSession, [name for name, _ in columns], row["n"]
    estimate: list[float | None] = [None] * p
    error: list[float | None] = [None] * p
    if n:
        square = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                square[i, j] = square[j, i] = row[f"s{i}_{j}"]
        right = np.array([row[f"b{i}"] for i in range(p)])
        free = _independent(square)
        inverse = np.linalg.inv(square[np.ix_(free, free)])
        beta = inverse @ right[free]
        left = max(0.0, row["yy"] - beta @ right[free])
        spare = n - len(free)
        for k, i in enumerate(free):
            estimate[i] = float(beta[k])
            error[i] = float(np.sqrt(left / spare * inverse[k, k])) if spare > 0 else None
    out = [
        (t, e, s, n, None if s is not None else "no rows" if not n else "determined by other terms" if e is None else "too few rows")
        for t, e, s in zip(terms, estimate, error, strict=True)
    ]
    margin = critical_value(alpha) * F.col("std_error")
    return (
        spark.range(1)
        .select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, RESULT.items(), strict=True)]) for r in out])))
        .withColumn("z", F.try_divide(F.col("estimate"), F.col("std_error")))
        .withColumns({"p_value": two_sided_p(F.col("z")), "ci_low": F.col("estimate") - margin, "ci_high": F.col("estimate") + margin})
    )


def _independent(square: np.ndarray) -> list[int]:
    """Columns, first come, that none before them determines (by Cholesky steps)."""
    rest, kept = square.copy(), []
    for i in range(len(square)):
        if square[i, i] > 0 and rest[i, i] > 1e-9 * square[i, i]:
            kept.append(i)
            rest = rest - np.outer(rest[:, i], rest[i]) / rest[i, i]
    return kept


def adjusted_conversion_lift(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Same-day conversion of user-days, adjusted for weekday and for new or returning users."""
    units = new_or_returning(events).withColumns(
        {"weekday": F.weekday("date"), "value": F.col("converted").cast("double")}
    )
    return adjusted_lift(units, "value", ["weekday", "segment"], alpha)
