"""Per-day readouts: tested conversion, guardrail intervals, ship decisions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.formatting import money, percent, pretty_round, signed_pp
from splitlane.functions.inference import (
    TEST_COLUMNS,
    mean_ci,
    proportion_ci,
    two_proportion_test,
)
from splitlane.functions.normal import critical_value_of
from splitlane.operators.dates import EVENT, day_of, newest
from splitlane.operators.guardrails import evaluate, scoped_metric_rows
from splitlane.operators.metrics import (
    ccr_first_exposure,
    ccr_rollup,
    ccr_same_day,
    guardrails_daily,
)
from splitlane.operators.quality import side_by_side
from splitlane.sources.contract import VARIANTS, EventTables


@dataclass(frozen=True)
class ExperimentPlan:
    """Preset parameters of an experiment."""

    name: str = "checkout_redesign_v1"
    alpha: float = 0.05
    mde_abs: float = 0.015


PLAN = ExperimentPlan()


def tested_cells(cells: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Pair the variants of ``adders, orders`` cells and test treatment on control.

    A variant without a cell has no adders.
    """
    wide = side_by_side(cells, keys, ["adders", "orders"])
    wide = wide.fillna(0, [f"{v}_{m}" for v in VARIANTS for m in ("adders", "orders")])
    return two_proportion_test(
        wide,
        "control_orders",
        "control_adders",
        "treatment_orders",
        "treatment_adders",
        alpha,
    )


def two_proportion_daily(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """The bounded same-day conversion test of every day."""
    return tested_cells(ccr_same_day(events), ["date"], alpha)


def ccr_summary(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """The first-exposure conversion test of every day.

    Days on which more users ordered than were first exposed cannot be tested; they
    stay in the result with their reason.
    """
    tested = tested_cells(ccr_first_exposure(events), ["date"], alpha)
    return tested.select(
        "date",
        "control_adders",
        "control_orders",
        F.col("p_a").alias("control_ccr"),
        "treatment_adders",
        "treatment_orders",
        F.col("p_b").alias("treatment_ccr"),
        *[c for c in TEST_COLUMNS if c not in ("p_a", "p_b", "z")],
        F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"),
    )


def auth_rate_ci(events: EventTables, alpha: float = 0.05) -> DataFrame:
    return proportion_ci(
        guardrails_daily(events).select(
            "date", "variant", "authorized", "total_attempts"
        ),
        "authorized",
        "total_attempts",
        alpha,
    )


def guardrails_summary(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Authorization rate with its interval and mean order value, per day and variant."""
    rated = proportion_ci(
        guardrails_daily(events), "authorized", "total_attempts", alpha
    )
    return rated.select(
        "date",
        "variant",
        "rate",
        "ci_low",
        "ci_high",
        "authorized",
        "total_attempts",
        F.col("aov").alias("mean_order_value"),
        "order_count",
    )


def aov_ci(events: EventTables, alpha: float = 0.05) -> DataFrame:
    orders = events.order_completed.select(
        day_of(EVENT).alias("date"), "variant", "order_value"
    )
    return mean_ci(orders, ["date", "variant"], "order_value", alpha)


def z_critical(events: EventTables, family_alpha: float = 0.05) -> DataFrame:
    """Critical values where alpha varies by row: the family alpha spread over days.

    Looking at the first d days spends ``family_alpha / d`` on each look.
    """
    start = F.min("date").over(Window.partitionBy())
    looks = F.date_diff(F.col("date"), start) + 1
    return (
        events.add_to_cart.select("date")
        .distinct()
        .withColumn("alpha", F.lit(family_alpha) / looks)
        .withColumn("z_crit", critical_value_of(F.col("alpha")))
    )


def _decision_columns(plan: ExperimentPlan) -> dict[str, Column]:
    significant = F.coalesce(F.col("p_value") < plan.alpha, F.lit(False))
    guarded = F.coalesce("guardrails_passed", F.lit(False))
    lift = F.coalesce("effect_abs", F.lit(0.0))
    ship, hold = F.lit("SHIP"), F.lit("DO NOT SHIP")
    return {
        "significant": significant,
        "guardrails_passed": guarded,
        # Significance and guardrails; blind to the sign and size of the effect.
        "decision_by_test": F.when(significant & guarded, ship).otherwise(hold),
        # Significance and sign; blind to guardrails.
        "decision_by_sign": F.when(significant & (lift > 0), ship)
        .when(significant & (lift < 0), hold)
        .otherwise("INCONCLUSIVE"),
        # The preregistered rule: significance, practical size and guardrails.
        "decision_by_plan": F.when(
            significant & (lift >= plan.mde_abs) & guarded, ship
        ).otherwise(hold),
    }


def ship_decision(events: EventTables, plan: ExperimentPlan = PLAN) -> DataFrame:
    """Effect, guardrails and the verdict of three rules, per day and for the window.

    The ``total`` row decides the experiment: each user counts once there. The daily
    rows look at the same data again and again at full alpha, so they only inform. A
    guardrail without data in an arm has failed.
    """
    guard = (
        evaluate(scoped_metric_rows(events))
        .groupBy("scope")
        .agg(
            F.min("passed").alias("guardrails_passed"),
            F.count_if(~F.col("passed")).alias("guardrails_failed"),
        )
    )
    return (
        tested_cells(ccr_rollup(events), ["scope"], plan.alpha)
        .select("scope", "effect_abs", "ci_low", "ci_high", "p_value", "invalid_reason")
        .join(guard, "scope", "left")
        .withColumns(_decision_columns(plan))
    )


def readout_labels(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Readout columns as people read them: rounded numbers and formatted labels."""
    tested = two_proportion_daily(events, alpha)
    money_by_day = side_by_side(guardrails_daily(events), ["date"], ["auth_rate", "aov"])
    return tested.join(money_by_day, "date", "left").select(
        "date",
        pretty_round(F.col("effect_abs")).alias("effect_rounded"),
        pretty_round(F.col("control_aov")).alias("aov_rounded"),
        signed_pp(F.col("effect_abs")).alias("effect_label"),
        F.concat(
            F.lit("["),
            signed_pp(F.col("ci_low")),
            F.lit(", "),
            signed_pp(F.col("ci_high")),
            F.lit("]"),
        ).alias("interval_label"),
        percent(F.col("p_a")).alias("control_label"),
        percent(F.col("p_b")).alias("treatment_label"),
        percent(F.col("control_auth_rate")).alias("control_auth_label"),
        money(F.col("treatment_aov")).alias("treatment_aov_label"),
    )


def auth_band(
    events: EventTables, low: float = 0.85, high: float = 0.95
) -> DataFrame:
    """Is each day's and variant's authorization rate in its plausible band?"""
    return guardrails_daily(events).select(
        "date",
        "variant",
        "auth_rate",
        F.col("auth_rate").between(low, high).alias("in_band"),
    )


def aa_parity(
    events: EventTables, auth_gap_pp: float = 0.5, aov_gap: float = 2.0
) -> DataFrame:
    """Are two supposedly equal variants close on both guardrails, day by day?"""
    wide = side_by_side(guardrails_daily(events), ["date"], ["auth_rate", "aov"])
    gap = F.abs(F.col("treatment_auth_rate") - F.col("control_auth_rate")) * 100.0
    money_gap = F.abs(F.col("treatment_aov") - F.col("control_aov"))
    return (
        wide.select("date", gap.alias("auth_gap_pp"), money_gap.alias("aov_gap"))
        .withColumn(
            "auth_parity", F.coalesce(F.col("auth_gap_pp") < auth_gap_pp, F.lit(False))
        )
        .withColumn("aov_parity", F.coalesce(F.col("aov_gap") < aov_gap, F.lit(False)))
    )


def impact_projection(events: EventTables, days_per_year: int = 365) -> DataFrame:
    """Orders and revenue gained per day if the measured lift held for everyone.

    Days that cannot be projected stay, without figures and with their reason.
    """
    tested = two_proportion_daily(events)
    wide = side_by_side(guardrails_daily(events), ["date"], ["aov"])
    adders = F.col("control_adders") + F.col("treatment_adders")
    return (
        tested.join(wide, "date", "left")
        .withColumn("incremental_orders", F.col("effect_abs") * adders)
        .withColumn(
            "incremental_revenue", F.col("incremental_orders") * F.col("treatment_aov")
        )
        .select(
            "date",
            "effect_abs",
            "incremental_orders",
            "incremental_revenue",
            (F.col("incremental_revenue") * days_per_year).alias("annual_revenue"),
            F.coalesce(
                "invalid_reason",
                F.when(F.col("treatment_aov").isNull(), "no order value"),
            ).alias("invalid_reason"),
        )
    )


def run_metadata(
    events: EventTables,
    run_at: dt.datetime,
    revision: str | None = None,
    seed: int | None = None,
    plan: ExperimentPlan = PLAN,
) -> DataFrame:
    """One row describing a run; the analysed day comes from the data."""
    spark = events.add_to_cart.sparkSession
    return spark.range(1).select(
        F.lit(run_at.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("run_at"),
        newest(events).alias("date_analyzed"),
        F.lit(revision).cast("string").alias("revision"),
        F.lit(plan.name).alias("experiment_name"),
        F.lit(seed).cast("bigint").alias("seed"),
    )
