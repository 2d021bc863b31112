"""Ordered lookups and percentiles that hold when one key owns much of the data.

Aggregations need no help: Spark combines them before the shuffle. Joins that bring one
value to every row of a key are left to adaptive execution, which splits a skewed side.
A look at a row's neighbour within its key is the shape that would put a whole key into
one task, so here every key is cut by time, in one plan whatever the size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.clock import epoch_seconds

NO_TIME = -(2**62)


def with_neighbour(
    df: DataFrame,
    key: str,
    time: str,
    tie_breaks: list[str],
    values: list[str],
    name: str,
    ahead: bool = False,
) -> DataFrame:
    """Add struct ``name``: ``values`` of the previous (or next) row of the same key.

    A key is cut by the second. Each piece finds neighbours inside itself; its edge row
    takes them from the nearest non-empty piece, carried through one row per (key,
    second): a task sees the rows of one second, or one edge per second of one key.
    Rows without a key belong to no group: they stay, and have no neighbours. Rows
    without a time sort first, as one piece.
    """
    order = [time, *tie_breaks]
    keyed = F.col(key).isNotNull()
    # Rows without a key are spread over pieces of their own; nothing looks at them.
    piece = F.when(keyed, F.coalesce(epoch_seconds(F.col(time)), F.lit(NO_TIME))).otherwise(
        F.xxhash64(*order)
    )
    cut = df.withColumn("_piece", piece)
    look: Callable[[Column], Column] = F.lead if ahead else F.lag
    inside = Window.partitionBy(key, "_piece").orderBy(*order)
    payload, position = F.struct(*values), F.struct(*order)
    edge = (F.min_by if ahead else F.max_by)(payload, position)
    carried = (
        cut.where(keyed)
        .groupBy(key, "_piece")
        .agg(edge.alias("_edge"))
        .withColumn(
            "_carried",
            look(F.col("_edge")).over(Window.partitionBy(key).orderBy("_piece")),
        )
        .drop("_edge")
    )
    near = F.when(keyed, F.coalesce("_near", "_carried"))
    return (
        cut.withColumn("_near", look(payload).over(inside))
        .join(carried, [key, "_piece"], "left")
        .withColumn(name, near)
        .drop("_near", "_carried", "_piece")
    )


def exact_percentiles(
    df: DataFrame,
    by: list[str],
    value: str,
    aggregates: dict[str, float],
    weight: str | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact percentiles per group from a histogram of distinct values.

    Rows collapse to (group, value, frequency) before the percentile sees them, so its
    state grows with distinct values (whole milliseconds or seconds), not with rows.
    ``extra`` aggregates see the histogram columns ``value`` and ``_n``.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    histogram = df.groupBy(*by, value).agg(count.alias("_n"))
    quantiles = [
        F.percentile(F.col(value), F.lit(p), F.col("_n")).alias(name)
        for name, p in aggregates.items()
    ]
    extras = [agg.alias(name) for name, agg in (extra or {}).items()]
    return histogram.groupBy(*by).agg(*quantiles, *extras)
