"""Do two distributions differ, and does a series shift? Rank, distance and cumulative sums.

Both tests of distributions need, at every value, how many rows of each variant lie below.
Rows first collapse to one per distinct value. Running counts then have two levels: values
are cut into pieces of neighbouring values, the pieces' totals are summed over the few
pieces, and inside a piece over its few values. So no task sorts all values of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.kolmogorov import kolmogorov_tail
from splitlane.functions.normal import two_sided_p
from splitlane.sources.contract import EventTables

#: Neighbouring whole values that make one piece.
PIECE = 1000


def running_counts(rows: DataFrame, by: list[str], value: str, piece: int = PIECE) -> DataFrame:
    """One row per group and distinct value: ``c`` and ``t`` rows of control and treatment there,
    ``c_below`` and ``t_below`` with a smaller value, ``n_c`` and ``n_t`` in all.

    Rows without a value, and of other variants, do not count.
    """
    at = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count_if(F.col("variant") == "control").alias("c"),
        F.count_if(F.col("variant") == "treatment").alias("t"),
    )
    cut = at.where(F.col("c") + F.col("t") > 0).withColumn("_piece", F.floor(F.col(value) / F.lit(piece)))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    inside = Window.partitionBy(*by, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)

    def until(name: str, window) -> Column:
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    pieces = (
        cut.groupBy(*by, "_piece")
        .agg(F.sum("c").alias("_c"), F.sum("t").alias("_t"))
        .select(
            *[F.col(b).alias(f"_key{i}") for i, b in enumerate(by)],
            F.col("_piece").alias("_of"),
            until("_c", before).alias("_c0"),
            until("_t", before).alias("_t0"),
            F.sum("_c").over(group).alias("n_c"),
            F.sum("_t").over(group).alias("n_t"),
        )
    )
    same = F.col("_piece") == F.col("_of")
    for i, b in enumerate(by):  # a group without a name is a group too
        same = same & F.col(b).eqNullSafe(F.col(f"_key{i}"))
    return (
        cut.withColumns({"_c1": until("c", inside), "_t1": until("t", inside)})
        .join(pieces, same)
        .select(
            *by,
            value,
            "c",
            "t",
            (F.col("_c0") + F.col("_c1")).alias("c_below"),
            (F.col("_t0") + F.col("_t1")).alias("t_below"),
            "n_c",
            "n_t",
        )
    )


def distribution_tests(
    rows: DataFrame, by: list[str], value: str, alpha: float = 0.05, piece: int = PIECE
) -> DataFrame:
    """Rank-sum and Kolmogorov-Smirnov tests of treatment against control, per group.

    ``superiority`` is the chance that a treatment row has the larger value, ties counted half;
    its test allows for ties and uses the normal limit. ``distance`` is the largest gap of the
    two distribution functions, with the limiting p-value, which ties make larger, and
    ``distance_at`` the smallest value where it is reached. A group with one variant only,
    or whose rows all have one value, keeps NULLs.
    """
    c, t, n_c, n_t = (F.col(x).cast("double") for x in ("c", "t", "n_c", "n_t"))
    f = c + t
    gap = F.abs(F.try_divide(F.col("c_below") + c, n_c) - F.try_divide(F.col("t_below") + t, n_t))
    sums = (
        running_counts(rows, by, value, piece)
        .withColumn("_gap", gap)
        .groupBy(*by)
        .agg(
            F.max("n_c").alias("control_rows"),
            F.max("n_t").alias("treatment_rows"),
            F.sum(t * (F.col("c_below") + c / 2.0)).alias("_u"),
            F.sum(f * f * f - f).alias("_ties"),
            F.max("_gap").alias("distance"),
            F.max_by(value, F.struct(F.round("_gap", 12), -F.col(value))).alias("distance_at"),
        )
    )
    n_c, n_t = F.col("control_rows").cast("double"), F.col("treatment_rows").cast("double")
    n, pairs = n_c + n_t, n_c * n_t
    variance = pairs / 12.0 * (n + 1.0 - F.try_divide(F.col("_ties"), n * (n - 1.0)))
    both = pairs > 0
    return (
        sums.withColumns(
            {
                "superiority": F.try_divide(F.col("_u"), pairs),
                "z": F.when(variance > 0, (F.col("_u") - pairs / 2.0) / F.sqrt(variance)),
                "distance": F.when(both, F.col("distance")),
                "distance_at": F.when(both & (F.col("distance") > 0), F.col("distance_at")),
                "_reach": F.when(both, F.col("distance") * F.sqrt(pairs / n)),
            }
        )
        .withColumns(
            {
                "rank_p_value": two_sided_p(F.col("z")),
                "distance_p_value": kolmogorov_tail(F.col("_reach")),
            }
        )
        .withColumn(
            "differs",
            F.coalesce(F.least("rank_p_value", "distance_p_value") < alpha / 2, F.lit(False)),
        )
        .drop("_u", "_ties", "_reach")
    )


def latency_tests(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Is a step slower for treatment than for control? By step; both tests share ``alpha``."""
    return distribution_tests(events.checkout_step_view, ["step_name"], "latency_ms", alpha)


def change_points(series: DataFrame, by: list[str], time: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Where the level of each series shifts, if it does.

    ``series`` is already grouped: one row per series and time. The cumulative sum of the
    distances from the mean walks like a Brownian bridge while the level holds; its
    largest absolute value, in units of the noise, is the statistic, and ``change_at`` the first
    time after it. The noise comes from differences of neighbours, which a shift does not
    inflate. Series of fewer than three values, or without noise and change, keep NULLs;
    rows without a value do not count.
    """
    whole = Window.partitionBy(*by)
    until = whole.orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = (
        series.where(F.col(value).isNotNull())
        .withColumns(
            {
                "_n": F.count(F.lit(1)).over(whole),
                "_mean": F.avg(value).over(whole),
                "_step": F.col(value) - F.lag(value).over(whole.orderBy(time)),
                "_next": F.lead(time).over(whole.orderBy(time)),
                "_sum": F.sum(value).over(until),
                "_i": F.row_number().over(whole.orderBy(time)),
            }
        )
        .withColumns(
            {
                "_walk": F.when(F.col("_i") < F.col("_n"), F.abs(F.col("_sum") - F.col("_i") * F.col("_mean"))),
                "_after": F.try_divide(F.col("_n") * F.col("_mean") - F.col("_sum"), F.col("_n") - F.col("_i")),
            }
        )
    )
    place = F.struct(F.round("_walk", 6), -F.col("_i"))
    sums = walked.groupBy(*by).agg(
        F.max("_n").alias("points"),
        F.max("_walk").alias("_reach"),
        F.max_by("_next", place).alias("change_at"),
        F.max_by(F.col("_sum") / F.col("_i"), place).alias("mean_before"),
        F.max_by("_after", place).alias("mean_after"),
        F.sqrt(F.avg(F.col("_step") * F.col("_step")) / 2.0).alias("noise"),
    )
    scaled = F.when(
        (F.col("points") > 2) & (F.col("noise") > 0),
        F.col("_reach") / (F.col("noise") * F.sqrt(F.col("points").cast("double"))),
    )
    return (
        sums.withColumn("statistic", scaled)
        .withColumn("p_value", kolmogorov_tail(F.col("statistic")))
        .withColumn("changed", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
        .withColumns(
            {c: F.when(F.col("statistic").isNotNull(), F.col(c)) for c in ("change_at", "mean_before", "mean_after")}
        )
        .drop("_reach")
    )


def hourly_series(events: EventTables) -> DataFrame:
    """Per hour: mean latency of each step, and errors of each step."""
    hour = F.date_trunc("hour", F.col("timestamp")).alias("hour")

    def named(measure: str) -> Column:
        return F.concat(F.lit(f"{measure}: "), F.coalesce("step_name", F.lit("(none)"))).alias("series")

    timed = F.col("timestamp").isNotNull()
    latency = (
        events.checkout_step_view.where(timed)
        .groupBy(named("latency"), hour)
        .agg(F.avg(F.col("latency_ms").cast("double")).alias("value"))
    )
    errors = events.form_error.where(timed).groupBy(named("errors"), hour).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    return latency.unionByName(errors)


def hourly_changes(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Shifts of latency and of errors over the window, per step."""
    return change_points(hourly_series(events), ["series"], "hour", "value", alpha)
