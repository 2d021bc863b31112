"""User, checkout-step and order marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.functions.formatting import settled
from splitlane.sources.contract import EventTables

STEP_KEYS = ["checkout_id", "step_name"]
STEP_GRAIN = ["checkout_id", "step_name", "step_index", "variant"]


def experiments(events: EventTables) -> DataFrame:
    """One row per user: stable variant and first exposure."""
    return events.add_to_cart.groupBy("user_id").agg(
        F.min("variant").alias("variant"),
        F.min("timestamp").alias("first_exposed_at"),
    )


def orders(events: EventTables) -> DataFrame:
    """One row per completed order."""
    return events.order_completed.select(
        "order_id",
        "checkout_id",
        "user_id",
        "order_value",
        "currency",
        "variant",
        F.col("timestamp").alias("ordered_at"),
    )


def _error_counts(events: EventTables) -> DataFrame:
    return events.form_error.groupBy(*STEP_KEYS).agg(F.count(F.lit(1)).alias("errors"))


def _step_mart(
    events: EventTables, error_events: Column, accuracy: int | None
) -> DataFrame:
    """Views and errors reduced on both sides before they meet.

    Views become one row per step and latency, errors one row per step, so nothing
    multiplies however often one checkout is viewed or fails.
    """
    views = events.checkout_step_view.groupBy(
        *STEP_GRAIN, *([] if accuracy else ["latency_ms"])
    ).agg(
        F.count(F.lit(1)).alias("views"),
        F.min("timestamp").alias("first_seen_at"),
        *([F.percentile_approx("latency_ms", 0.5, accuracy).alias("_median")] if accuracy else []),
    )
    median = (
        F.max("_median")
        if accuracy
        else F.percentile(F.col("latency_ms"), F.lit(0.5), F.col("views"))
    )
    return (
        views.join(_error_counts(events), STEP_KEYS, "left")
        .withColumn("errors", F.coalesce("errors", F.lit(0)))
        .groupBy(*STEP_GRAIN)
        .agg(
            F.min("first_seen_at").alias("first_seen_at"),
            F.floor(median).cast("int").alias("median_latency_ms"),
            error_events.alias("error_events"),
        )
    )


def checkout_steps(events: EventTables, accuracy: int | None = None) -> DataFrame:
    """One row per checkout and step, counted as a join of raw views and errors would.

    In that join every view meets every error of its step: k views and e errors give
    k * e error events, which the counts give without making those pairs. Every view
    is repeated equally often, which leaves the median as it is. ``accuracy`` asks
    for an approximate median instead of the exact one.
    """
    return _step_mart(events, F.sum(F.col("views") * F.col("errors")), accuracy)


def checkout_steps_exact(events: EventTables, accuracy: int | None = None) -> DataFrame:
    """One row per checkout and step; every view and every error counts once."""
    return _step_mart(events, F.max("errors"), accuracy)


def step_progression(steps: DataFrame) -> DataFrame:
    """Checkouts, mean of median latencies and errors per 100 checkouts, by step."""
    checkouts = F.count_distinct("checkout_id")
    return (
        steps.groupBy("step_name", "step_index")
        .agg(
            checkouts.alias("checkouts"),
            settled(F.avg("median_latency_ms"), 0).alias("avg_median_latency_ms"),
            settled(F.sum("error_events") * F.lit(100.0) / checkouts, 1).alias(
                "error_rate_pct"
            ),
        )
        .orderBy("step_index")
    )
