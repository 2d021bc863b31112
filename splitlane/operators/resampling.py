"""Bootstrap, permutation, interaction tests and multiple-testing adjustment."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.assignment import draw, draw_threshold, variant_of_digest
from splitlane.functions.inference import two_proportion_test
from splitlane.functions.normal import two_sided_p
from splitlane.operators.metrics import guardrails_daily
from splitlane.operators.power import known_user_days, with_digests
from splitlane.operators.quality import side_by_side
from splitlane.operators.readout import two_proportion_daily
from splitlane.sources.contract import EventTables

#: Cumulative Poisson(1) probabilities of 0, 1, 2, ... resample copies. What lies beyond
#: the last is less than one step of a 32-bit draw, so no draw is cut off.
POISSON_ONE = tuple(accumulate(exp(-1) / factorial(k) for k in range(13)))


def poisson_weight(digest: Column) -> Column:
    """How often a unit enters a bootstrap resample: Poisson(1), from its digest."""
    value = draw(digest, 0)
    return sum(
        (value >= draw_threshold(p)).cast("int") for p in POISSON_ONE
    )  # type: ignore[return-value]


def _rate_gap(sums: DataFrame, by: list[str]) -> DataFrame:
    wide = side_by_side(sums, by, ["adders", "orders"])
    rate = {
        v: F.try_divide(F.col(f"{v}_orders").cast("double"), F.col(f"{v}_adders"))
        for v in ("control", "treatment")
    }
    return wide.withColumn("effect", rate["treatment"] - rate["control"])


def bootstrap_ci(
    events: EventTables, repeats: int = 100, salt: str = "bootstrap", alpha: float = 0.05
) -> DataFrame:
    """Percentile interval of the conversion effect from a Poisson bootstrap.

    Each user draws a weight in each resample and brings all their days with it, so
    resamples need no central sampling and reduce to two sums per arm before any shuffle.
    """
    dealt = with_digests(known_user_days(events), ["variant"], repeats, salt)
    resampled = (
        dealt.withColumn("weight", poisson_weight(F.col("digest")))
        .groupBy("replicate", "variant")
        .agg(
            F.sum(F.col("weight") * F.col("days")).alias("adders"),
            F.sum(F.col("weight") * F.col("orders")).alias("orders"),
        )
    )
    return _rate_gap(resampled, ["replicate"]).agg(
        F.count("effect").alias("replicates"),
        F.avg("effect").alias("effect_mean"),
        F.stddev_samp("effect").alias("effect_std"),
        F.percentile("effect", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("effect", F.lit(1 - alpha / 2)).alias("ci_high"),
    )


def permutation_test(
    events: EventTables, repeats: int = 100, salt: str = "permute"
) -> DataFrame:
    """Two-sided p-value of the observed effect among re-dealt labels.

    Users are re-dealt with all their days. Each replicate counts by dealt and by real
    label in one pass, so the observed effect needs no second look at the traffic.
    """

    def effect(label: str) -> str:
        rates = [
            f"try_divide(sum(if({label} = '{v}', orders, 0)), sum(if({label} = '{v}', days, 0)))"
            for v in ("treatment", "control")
        ]
        return " - ".join(rates)

    dealt = with_digests(known_user_days(events), ["variant"], repeats, salt)
    effects = (
        dealt.withColumn("dealt", variant_of_digest(F.col("digest")))
        .groupBy("replicate")
        .agg(
            F.expr(effect("dealt")).alias("effect"),
            F.expr(effect("variant")).alias("observed"),
        )
    )
    return (
        effects.where(F.col("effect").isNotNull())
        .groupBy("observed")
        .agg(
            F.count(F.lit(1)).alias("replicates"),
            F.count_if(F.abs("effect") >= F.abs("observed")).alias("as_extreme"),
        )
        .withColumn(
            "p_value",
            (F.col("as_extreme") + 1).cast("double") / (F.col("replicates") + 1),
        )
    )


def adjust_p_values(tests: DataFrame, family: str, p: str) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg p-values within each family.

    Input is one row per test; a family is as long as the number of tests in it.
    Tests without a p-value rank last, count for nothing and get NULLs.
    """
    everyone = Window.partitionBy(family)
    ordered = everyone.orderBy(F.asc_nulls_last(p), "test")
    upwards = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    downwards = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = tests.withColumns(
        {"_m": F.count(p).over(everyone), "_rank": F.row_number().over(ordered)}
    )
    stepped = ranked.withColumns(
        {
            "_holm": F.col(p) * (F.col("_m") - F.col("_rank") + 1),
            "_bh": F.col(p) * F.col("_m") / F.col("_rank"),
        }
    )
    one, tested = F.lit(1.0), F.col(p).isNotNull()

    def capped(value: Column) -> Column:
        return F.when(tested, F.least(one, value))

    return stepped.select(
        family,
        "test",
        p,
        capped(F.col(p) * F.col("_m")).alias("bonferroni"),
        capped(F.max("_holm").over(upwards)).alias("holm"),
        capped(F.min("_bh").over(downwards)).alias("benjamini_hochberg"),
    )


def daily_tests(events: EventTables) -> DataFrame:
    """Daily p-values of conversion and of payment authorization, two families."""
    ccr = two_proportion_daily(events).select(
        F.lit("ccr").alias("family"), F.col("date").cast("string").alias("test"), "p_value"
    )
    wide = side_by_side(
        guardrails_daily(events), ["date"], ["authorized", "total_attempts"]
    )
    auth = two_proportion_test(
        wide,
        "control_authorized",
        "control_total_attempts",
        "treatment_authorized",
        "treatment_total_attempts",
    ).select(
        F.lit("payment_auth").alias("family"),
        F.col("date").cast("string").alias("test"),
        "p_value",
    )
    return ccr.unionByName(auth)


def p_adjust(events: EventTables) -> DataFrame:
    return adjust_p_values(daily_tests(events), "family", "p_value")


def interaction_test(lifts: DataFrame, segment: str, first: str, second: str) -> DataFrame:
    """Does the treatment effect differ between two segments?

    ``lifts`` has one tested row per segment. The difference of effects is compared
    with the root of the two summed variances.
    """

    def pick(value: str, column: Column) -> Column:
        return F.max(F.when(F.col(segment) == value, column))

    p_a, p_b = F.col("p_a"), F.col("p_b")
    variance = F.try_divide(p_a * (1.0 - p_a), F.col("control_adders")) + F.try_divide(
        p_b * (1.0 - p_b), F.col("treatment_adders")
    )
    gaps = lifts.agg(
        pick(first, F.col("effect_abs")).alias("effect_first"),
        pick(second, F.col("effect_abs")).alias("effect_second"),
        (pick(first, variance) + pick(second, variance)).alias("_variance"),
    )
    return (
        gaps.withColumn("difference", F.col("effect_second") - F.col("effect_first"))
        .withColumn("z", F.try_divide(F.col("difference"), F.sqrt("_variance")))
        .withColumn("p_value", two_sided_p(F.col("z")))
        .drop("_variance")
    )
