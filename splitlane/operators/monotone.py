"""Detection rates that never fall with the sample, and the sample that a power needs.

Rates of a finished grid are noisy: a larger sample may show a lower rate by chance. The
monotone fit pools neighbours that are out of order, weighted by their repeats. All inputs
here are a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGETS = (0.5, 0.8, 0.95)


def monotone_rates(grid: DataFrame, by: str = "uplift", size: str = "users_tested") -> DataFrame:
    """``fitted_rate`` next to each point's own: the closest rising curve by least squares.

    The fit at a point is the largest, over all beginnings up to it, of the smallest mean
    over all ends from it on. Points of one size are one point first. The order of the
    rows does not matter; points without a rate or a size are left out.
    """
    points = (
        grid.where(F.col(size).isNotNull() & F.col("detection_rate").isNotNull())
        .groupBy(by, size)
        .agg(
            F.sum("repeats").alias("repeats"),
            F.try_divide(F.sum(F.col("detection_rate") * F.col("repeats")), F.sum("repeats")).alias("detection_rate"),
        )
        .where(F.col("repeats") > 0)
    )
    listed = points.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct(F.col(size).alias("size"), "repeats", "detection_rate"))).alias("_p")
    )

    def mean(first: Column, last: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))

        def add(total: Column, point: Column) -> Column:
            return F.struct(
                (total["w"] + point["repeats"]).alias("w"),
                (total["s"] + point["repeats"] * point["detection_rate"]).alias("s"),
            )

        part = F.slice("_p", first, last - first + 1)
        return F.aggregate(part, zero, add, lambda t: t["s"] / t["w"])

    n = F.size("_p")
    fits = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.array_max(
            F.transform(
                F.sequence(F.lit(1), i),
                lambda j: F.array_min(F.transform(F.sequence(i, n), lambda k: mean(j, k))),
            )
        ),
    )
    return listed.select(by, F.inline(F.arrays_zip(F.col("_p"), fits.alias("fitted_rate")))).select(
        by,
        F.col("_p.size").alias(size),
        F.col("_p.repeats").alias("repeats"),
        F.col("_p.detection_rate").alias("detection_rate"),
        "fitted_rate",
    )


def sample_size_for_power(
    grid: DataFrame, targets: tuple[float, ...] = TARGETS, by: str = "uplift", size: str = "users_tested"
) -> DataFrame:
    """Users needed to detect each uplift with each power, read off the monotone fit.

    Between the last point below the target and the first at or above it the curve is a
    straight line. ``within_grid`` is false where the smallest size already has the power, which
    is then an upper bound, and where no size has it: then ``users_needed`` is NULL.
    """
    wanted = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target_power")
    fitted = monotone_rates(grid, by, size).select("*", wanted)
    low = F.col("fitted_rate") < F.col("target_power")
    point = F.struct(F.col(size).alias("size"), F.col("fitted_rate").alias("rate"))
    ends = fitted.groupBy(by, "target_power").agg(
        F.max(F.when(low, point)).alias("_a"), F.min(F.when(~low, point)).alias("_b")
    )
    a, b = F.col("_a"), F.col("_b")
    share = (F.col("target_power") - a["rate"]) / (b["rate"] - a["rate"])
    line = F.ceil(a["size"] + share * (b["size"] - a["size"]) - 1e-9)
    return ends.select(
        by,
        "target_power",
        F.when(b.isNotNull() & a.isNotNull(), line).otherwise(b["size"]).cast("bigint").alias("users_needed"),
        (a.isNotNull() & b.isNotNull()).alias("within_grid"),
    )
