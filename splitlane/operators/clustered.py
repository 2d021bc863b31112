"""Effects whose rows come in clusters: users with several days or orders each.

Rows of one user are alike, so they say less than as many rows of different users. Each
cluster is reduced to two sums and a square, and all clusters of a variant to a handful of
moments: one shuffle by cluster, then one row per variant, however many rows a user has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.functions.normal import critical_value, two_sided_p
from splitlane.operators.metrics import user_days
from splitlane.operators.quality import side_by_side
from splitlane.sources.contract import EventTables

MOMENTS = ("clusters", "rows", "total", "rows_sq", "total_sq", "product", "squares", "between", "unclustered_rows")


def cluster_moments(rows: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    """Moments of the clusters per group, ``by`` holding ``variant``.

    With x the rows of a cluster and y the sum of their values: ``rows`` is the sum of x, ``total`` of y,
    ``rows_sq``, ``total_sq`` and ``product`` those of x², y² and xy, ``between`` of y²/x, and
    ``squares`` that of the squared values. Rows without a value are not measured; rows without a
    cluster cannot be told apart and are counted as ``unclustered_rows`` only.
    """
    known = F.col(cluster).isNotNull()
    per_cluster = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*by, cluster)
        .agg(
            F.count(F.lit(1)).cast("double").alias("x"),
            F.sum(F.col(value).cast("double")).alias("y"),
            F.sum(F.col(value).cast("double") * F.col(value)).alias("q"),
        )
    )
    x, y = (F.when(known, F.col(c)) for c in ("x", "y"))

    def total(of: Column, name: str) -> Column:
        return F.coalesce(F.sum(of), F.lit(0.0)).alias(name)

    return per_cluster.groupBy(*by).agg(
        F.count_if(known).alias("clusters"),
        total(x, "rows"),
        total(y, "total"),
        total(x * x, "rows_sq"),
        total(y * y, "total_sq"),
        total(x * y, "product"),
        total(F.when(known, F.col("q")), "squares"),
        total(y * y / x, "between"),
        F.coalesce(F.sum(F.when(~known, F.col("x"))), F.lit(0.0)).cast("bigint").alias("unclustered_rows"),
    )


def cluster_estimates(moments: DataFrame, by: list[str]) -> DataFrame:
    """Mean, its variance by the delta method over clusters, and how alike a cluster's rows are.

    ``variance`` treats the mean as a ratio of two cluster sums; ``naive_variance`` treats rows as
    independent; ``design_effect`` is their quotient. ``icc`` is the share of the variance that a
    random intercept per cluster takes, from the mean squares between and within clusters of
    unequal sizes. What needs two clusters, or a repeated one, is NULL without.
    """
    n, rows, total = F.col("clusters"), F.col("rows"), F.col("total")
    mean = F.try_divide(total, rows)
    spread = F.col("total_sq") - 2.0 * F.col("mean") * F.col("product") + F.col("mean") * F.col("mean") * F.col("rows_sq")
    within = F.try_divide(F.col("squares") - F.col("between"), rows - n)
    among = F.try_divide(F.col("between") - F.try_divide(total * total, rows), n - 1)
    size = F.try_divide(rows - F.try_divide(F.col("rows_sq"), rows), n - 1)
    naive = F.try_divide(F.col("squares") - rows * F.col("mean") * F.col("mean"), (rows - 1.0) * rows)
    return (
        moments.withColumn("mean", mean)
        .withColumns(
            {
                "variance": F.try_divide(n * F.greatest(spread, F.lit(0.0)), (n - 1) * rows * rows),
                "naive_variance": F.when(rows > 1, F.greatest(naive, F.lit(0.0))),
                "icc": F.try_divide(among - within, among + (size - 1.0) * within),
            }
        )
        .withColumn("design_effect", F.try_divide(F.col("variance"), F.col("naive_variance")))
        .select(*by, "clusters", F.col("rows").cast("bigint").alias("rows"), "mean", "variance", "design_effect", "icc", "unclustered_rows")
    )


def clustered_effect(estimates: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Treatment against control per group, with errors that allow for the clusters.

    A group with one variant, or with fewer than two clusters in one, keeps NULL results and a
    ``invalid_reason``.
    """
    columns = ["clusters", "rows", "mean", "variance", "design_effect", "icc", "unclustered_rows"]
    wide = side_by_side(estimates, by, columns)
    margin = critical_value(alpha) * F.col("std_error")
    reason = F.when(F.col("control_rows").isNull() | F.col("treatment_rows").isNull(), "missing variant").when(
        F.least("control_clusters", "treatment_clusters") < 2, "fewer than two clusters"
    )
    return (
        wide.withColumns(
            {
                "effect_abs": F.col("treatment_mean") - F.col("control_mean"),
                "std_error": F.sqrt(F.col("control_variance") + F.col("treatment_variance")),
                "invalid_reason": reason,
            }
        )
        .withColumns(
            {
                "z": F.try_divide(F.col("effect_abs"), F.col("std_error")),
                "ci_low": F.col("effect_abs") - margin,
                "ci_high": F.col("effect_abs") + margin,
            }
        )
        .withColumn("p_value", two_sided_p(F.col("z")))
        .drop("control_variance", "treatment_variance")
    )


def clustered_effects(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Same-day conversion per user-day, and value per order, clustered by user."""
    days = user_days(events).where(F.col("variant").isNotNull()).select(
        F.lit("conversion").alias("metric"), "variant", "user_id", F.col("converted").cast("double").alias("value")
    )
    orders = events.order_completed.where(F.col("variant").isNotNull()).select(
        F.lit("order_value").alias("metric"), "variant", "user_id", F.col("order_value").alias("value")
    )
    by = ["metric", "variant"]
    moments = cluster_moments(days.unionByName(orders), by, "user_id", "value")
    return clustered_effect(cluster_estimates(moments, by), ["metric"], alpha)
