"""Tables read off a finished power grid. All inputs here are a few dozen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR_MDE = 0.005
POWER_TARGETS = (50, 80, 95)


def power_table(grid: DataFrame) -> DataFrame:
    """The full grid with percentages."""
    hundredfold = {
        f"{name}_pct": F.col(name) * 100.0
        for name in ("uplift", "detection_rate", "alpha")
    }
    return grid.withColumns(hundredfold).select(
        "users_per_day",
        "users_tested",
        "uplift_pct",
        "detection_rate_pct",
        "detections",
        "repeats",
        "alpha_pct",
    )


def power_near_mde(grid: DataFrame, mde: float = 0.015) -> DataFrame:
    """The most powerful point near the MDE, or else the positive uplift closest to it.

    Ties go to the earlier grid point: fewer users, then the smaller uplift.
    """
    distance = F.abs(F.col("uplift") - mde)
    near = (distance <= NEAR_MDE).cast("int")
    grid_order = [F.col("users_per_day"), F.col("uplift")]
    return (
        grid.where(F.col("uplift") > 0)
        .withColumns({"_near": near, "distance": distance})
        .orderBy(
            F.desc("_near"),
            F.when(F.col("_near") == 1, F.col("detection_rate")).desc_nulls_last(),
            F.when(F.col("_near") == 0, F.col("distance")).asc_nulls_last(),
            *grid_order,
        )
        .limit(1)
        .withColumn("near_mde", F.col("_near") == 1)
        .drop("_near", "distance")
    )


def power_best_by_uplift(grid: DataFrame) -> DataFrame:
    """The best detection rate of each positive uplift, at its smallest sample."""
    best = Window.partitionBy("uplift").orderBy(
        F.desc("detection_rate"), F.asc("users_per_day")
    )
    return (
        grid.where(F.col("uplift") > 0)
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def power_curve(grid: DataFrame) -> DataFrame:
    """Detection rate by positive uplift at the smallest and largest sample size."""
    everything = Window.partitionBy()
    smallest = F.min("users_per_day").over(everything)
    largest = F.max("users_per_day").over(everything)
    label = F.when(F.col("users_per_day") == smallest, "smallest").when(
        F.col("users_per_day") == largest, "largest"
    )
    return (
        grid.withColumns({"size": label, "uplift_pct": F.col("uplift") * 100.0})
        .where((F.col("uplift") > 0) & F.col("size").isNotNull())
        .groupBy("uplift_pct")
        .pivot("size", ["smallest", "largest"])
        .agg(F.first("detection_rate"))
    )


def power_grid_shape(grid: DataFrame) -> DataFrame:
    return grid.agg(
        F.count(F.lit(1)).alias("grid_points"),
        F.count_distinct("users_per_day").alias("sample_sizes"),
        F.count_distinct("uplift").alias("uplifts"),
        F.sum("repeats").alias("total_runs"),
    )


def sample_size_table(grid: DataFrame) -> DataFrame:
    """The smallest tested sample reaching each power target, per uplift (0 is the A/A row).

    Where no tested sample reaches a target, the row shows the largest one tried.
    """
    targets = F.array(*[F.lit(t) for t in POWER_TARGETS])
    enough = F.col("detection_rate") >= F.col("target_pct") / 100.0
    smallest = F.min(F.when(enough, F.col("users_tested")))
    return (
        grid.withColumn("target_pct", F.explode(targets))
        .groupBy("uplift", "target_pct")
        .agg(
            smallest.isNotNull().alias("reached"),
            F.coalesce(smallest, F.max("users_tested")).alias("users_tested"),
        )
    )


def false_positive_rate(grid: DataFrame) -> DataFrame:
    """Detections where nothing was changed, against the nominal alpha."""
    return grid.where(F.col("uplift") == 0).select(
        "users_per_day",
        "users_tested",
        "repeats",
        "detections",
        "detection_rate",
        "alpha",
    )
