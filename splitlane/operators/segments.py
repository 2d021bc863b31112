"""Tests over any number of segments and arms at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.chi_square import chi_square_tail
from splitlane.operators.diagnostics import new_or_returning, segment_cut
from splitlane.operators.metrics import user_days
from splitlane.sources.contract import EventTables

#: The planned split; arms that nobody planned have share 0.
EVEN_SPLIT = {"control": 0.5, "treatment": 0.5}


def effect_heterogeneity(lifts: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Do the treatment effects of all segments of a group differ?

    ``lifts`` has one tested row per segment (``p_a``, ``p_b`` and the adders of both variants).
    Effects are weighted by their precision; their weighted squared distances from the pooled
    effect are chi-square with one degree of freedom less than segments. Segments that
    cannot be tested, or without variance, have no weight and are counted as ``left_out``.
    ``inconsistency`` is the share of the distances beyond what chance gives.
    """
    p_a, p_b = F.col("p_a"), F.col("p_b")
    variance = F.try_divide(p_a * (1.0 - p_a), F.col("control_adders")) + F.try_divide(
        p_b * (1.0 - p_b), F.col("treatment_adders")
    )
    effect, weight = F.col("effect_abs"), F.when(variance > 0, 1.0 / variance)
    # Σ w (e - ē)² = Σ w e² - (Σ w e)² / Σ w, all from one pass
    sums = lifts.withColumn("_w", weight).groupBy(*by).agg(
        F.count("_w").alias("segments"),
        F.count_if(F.col("_w").isNull()).alias("left_out"),
        F.sum("_w").alias("_w"),
        F.sum(F.col("_w") * effect).alias("_we"),
        F.sum(F.col("_w") * effect * effect).alias("_wee"),
    )
    q = F.greatest(F.col("_wee") - F.try_divide(F.col("_we") * F.col("_we"), F.col("_w")), F.lit(0.0))
    degrees = F.when(F.col("segments") > 1, F.col("segments") - 1)
    return (
        sums.withColumns(
            {
                "pooled_effect": F.try_divide(F.col("_we"), F.col("_w")),
                "q": F.when(degrees.isNotNull(), q),
                "degrees": degrees,
            }
        )
        .withColumns(
            {
                "p_value": chi_square_tail(F.col("q"), F.col("degrees")),
                "inconsistency": F.greatest(F.try_divide(F.col("q") - F.col("degrees"), F.col("q")), F.lit(0.0)),
            }
        )
        .withColumn("differs", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
        .drop("_w", "_we", "_wee")
    )


def split_test(counts: DataFrame, by: list[str], shares: Mapping[str, float], alpha: float = 0.05) -> DataFrame:
    """Do the users of each group fall on the arms as planned? For any number of arms.

    ``counts`` has ``arm`` and ``n`` per group. Shares are scaled to add up to 1; an arm of
    the plan without users counts as 0. Users of an arm outside the plan are
    ``unplanned_users`` and a mismatch whatever the other arms say.
    """
    whole = sum(shares.values())
    if not shares or min(shares.values()) <= 0:
        raise ValueError("every planned arm needs a share above 0")
    planned = F.col("arm").isin(*shares)
    picks = [F.coalesce(F.sum(F.when(F.col("arm") == a, F.col("n"))), F.lit(0)).alias(f"_{i}") for i, a in enumerate(shares)]
    sums = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(planned, F.col("n"))), F.lit(0)).alias("users"),
        F.coalesce(F.sum(F.when(~F.coalesce(planned, F.lit(False)), F.col("n"))), F.lit(0)).alias("unplanned_users"),
        *picks,
    )
    parts = []
    for i, share in enumerate(shares.values()):
        expected = F.col("users") * F.lit(share / whole)
        parts.append(F.try_divide((F.col(f"_{i}") - expected) * (F.col(f"_{i}") - expected), expected))
    chi: Column = sum(parts[1:], parts[0])
    return (
        sums.withColumns({"chi_square": chi, "degrees": F.lit(len(shares) - 1).cast("bigint")})
        .withColumn("p_value", chi_square_tail(F.col("chi_square"), F.col("degrees")))
        .withColumn("mismatch", F.coalesce(F.col("p_value") < alpha, F.lit(False)) | (F.col("unplanned_users") > 0))
        .drop(*[f"_{i}" for i in range(len(shares))])
    )


def split_homogeneity(counts: DataFrame, by: list[str], segment: str, alpha: float = 0.05) -> DataFrame:
    """Is the split the same in all segments of a group, whatever it is?

    ``counts`` has ``arm`` and ``n`` per group and segment; cells that are not there are 0. The
    chi-square of the table has (segments - 1) times (arms - 1) degrees of freedom. The windows
    run over the cells, which are few.
    """
    group, row, column = (Window.partitionBy(*by, *more) for more in ([], [segment], ["arm"]))
    marked = counts.where(F.col("n") > 0).withColumns(
        {
            "_all": F.sum("n").over(group),
            "_row": F.sum("n").over(row),
            "_column": F.sum("n").over(column),
        }
    )
    # Σ (n - e)² / e over all cells = N (Σ n² / (row · column) - 1); empty cells add nothing
    sums = marked.groupBy(*by).agg(
        F.count_distinct(segment).alias("segments"),
        F.count_distinct("arm").alias("arms"),
        F.max("_all").alias("users"),
        F.sum(F.col("n").cast("double") * F.col("n") / F.col("_row") / F.col("_column")).alias("_share"),
    )
    degrees = (F.col("segments") - 1) * (F.col("arms") - 1)
    return (
        sums.withColumns(
            {
                "chi_square": F.greatest(F.col("users") * (F.col("_share") - 1.0), F.lit(0.0)),
                "degrees": degrees,
            }
        )
        .withColumn("p_value", chi_square_tail(F.col("chi_square"), F.col("degrees")))
        .withColumn("mismatch", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
        .drop("_share")
    )


def _segmented(events: EventTables) -> dict[str, DataFrame]:
    units = user_days(events)
    return {
        "new_or_returning": new_or_returning(events),
        "weekday": units.withColumn("segment", F.weekday("date").cast("string")),
        "day": units.withColumn("segment", F.col("date").cast("string")),
    }


def lift_heterogeneity(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Effects by weekday, by day, and of new and returning users: do they differ?"""
    lifts = None
    for cut, units in _segmented(events).items():
        one = segment_cut(units, "segment", alpha).withColumn("cut", F.lit(cut))
        lifts = one if lifts is None else lifts.unionByName(one)
    return effect_heterogeneity(lifts, ["cut"], alpha)


def _arm_counts(events: EventTables) -> DataFrame:
    counts = None
    for cut, units in _segmented(events).items():
        one = units.groupBy(F.lit(cut).alias("cut"), "segment", F.col("variant").alias("arm")).agg(F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def srm_by_segment(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Each segment's split against the plan."""
    return split_test(_arm_counts(events), ["cut", "segment"], EVEN_SPLIT, alpha)


def srm_homogeneity(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Does the split change from segment to segment?"""
    return split_homogeneity(_arm_counts(events), ["cut"], "segment", alpha)
