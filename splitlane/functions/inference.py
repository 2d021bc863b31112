"""Tests and intervals applied to every row of a table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.functions.normal import critical_value, two_sided_p

TEST_COLUMNS = (
    "p_a",
    "p_b",
    "effect_abs",
    "effect_rel",
    "z",
    "p_value",
    "ci_low",
    "ci_high",
    "invalid_reason",
)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def count_problem(successes: Column, total: Column) -> Column:
    """Why a (successes, total) pair cannot be tested, or NULL when it can."""
    return (
        F.when(successes.isNull() | total.isNull(), "missing counts")
        .when(total <= 0, "no observations")
        .when(successes < 0, "negative successes")
        .when(successes > total, "successes exceed observations")
    )


def _refuse_invalid(df: DataFrame) -> DataFrame:
    failed = F.raise_error(F.concat(F.lit("invalid counts: "), F.col("invalid_reason")))
    checked = F.when(F.col("invalid_reason").isNull(), F.lit(None)).otherwise(failed)
    return df.withColumn("invalid_reason", checked.cast("string"))


def two_proportion_test(
    df: DataFrame,
    successes_a: str,
    total_a: str,
    successes_b: str,
    total_b: str,
    alpha: float = 0.05,
    strict: bool = False,
) -> DataFrame:
    """Two-sided z-test of two proportions, group b against group a.

    The p-value uses the pooled standard error and the interval the unpooled one.
    ``effect_rel`` is infinite when group a has no successes. Rows whose counts cannot
    be tested keep NULL results and an ``invalid_reason``; with ``strict`` they fail
    the job instead.
    """
    z_crit = critical_value(alpha)
    s_a, n_a = F.col(successes_a), F.col(total_a)
    s_b, n_b = F.col(successes_b), F.col(total_b)
    df = df.withColumn(
        "invalid_reason", F.coalesce(count_problem(s_a, n_a), count_problem(s_b, n_b))
    )
    if strict:
        df = _refuse_invalid(df)
    valid = F.col("invalid_reason").isNull()
    pooled = _ratio(s_a + s_b, n_a + n_b)
    df = df.withColumns(
        {
            "p_a": F.when(valid, _ratio(s_a, n_a)),
            "p_b": F.when(valid, _ratio(s_b, n_b)),
            "_pooled": F.when(valid, pooled),
        }
    )
    p_a, p_b, p = F.col("p_a"), F.col("p_b"), F.col("_pooled")
    spread = F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)
    df = df.withColumns(
        {
            "effect_abs": p_b - p_a,
            "_se_pooled": F.sqrt(F.when(valid, p * (1.0 - p) * spread)),
            "_se_split": F.sqrt(
                F.when(
                    valid,
                    F.try_divide(p_a * (1.0 - p_a), n_a)
                    + F.try_divide(p_b * (1.0 - p_b), n_b),
                )
            ),
        }
    )
    effect, margin = F.col("effect_abs"), F.col("_se_split") * z_crit
    df = df.withColumns(
        {
            "effect_rel": F.when(p_a > 0, F.try_divide(effect, p_a)).when(
                valid, F.lit(float("inf"))
            ),
            "z": F.when(
                F.col("_se_pooled") > 0, F.try_divide(effect, F.col("_se_pooled"))
            ).when(valid, F.lit(0.0)),
            "ci_low": effect - margin,
            "ci_high": effect + margin,
        }
    )
    return df.withColumn("p_value", two_sided_p(F.col("z"))).drop(
        "_pooled", "_se_pooled", "_se_split"
    )


def proportion_ci(
    df: DataFrame, successes: str, total: str, alpha: float = 0.05, prefix: str = ""
) -> DataFrame:
    """Wald interval of one proportion, clipped to [0, 1]; adds rate, ci_low, ci_high."""
    z_crit = critical_value(alpha)
    s, n = F.col(successes), F.col(total)
    rate_name = f"{prefix}rate"
    valid = count_problem(s, n).isNull()
    df = df.withColumn(rate_name, F.when(valid, _ratio(s, n)))
    rate = F.col(rate_name)
    margin = F.sqrt(F.try_divide(rate * (1.0 - rate), n)) * z_crit
    # greatest/least skip NULLs, so the bounds must be NULL together with the rate.
    return df.withColumns(
        {
            f"{prefix}ci_low": F.when(valid, F.greatest(F.lit(0.0), rate - margin)),
            f"{prefix}ci_high": F.when(valid, F.least(F.lit(1.0), rate + margin)),
        }
    )


def mean_ci(
    df: DataFrame, by: list[str], value: str, alpha: float = 0.05
) -> DataFrame:
    """Normal interval of a mean per group; groups of fewer than two rows get NULLs."""
    z_crit = critical_value(alpha)
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )
    margin = F.try_divide(F.col("std"), F.sqrt(F.col("n"))) * z_crit
    enough = F.col("n") >= 2
    return stats.withColumns(
        {
            "ci_low": F.when(enough, F.col("mean") - margin),
            "ci_high": F.when(enough, F.col("mean") + margin),
        }
    )


def chi_square_even_split(left: Column, right: Column) -> Column:
    """One-degree chi-square statistic of two counts against a 50/50 split."""
    gap = (left - right).cast("double")
    return F.try_divide(gap * gap, (left + right).cast("double"))
