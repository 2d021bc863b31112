"""The result files and mart tables of a run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.operators import marts, metrics, readout
from splitlane.operators.quality import side_by_side
from splitlane.sources import sinks
from splitlane.sources.contract import VARIANTS, EventTables

CCR_RECORD = (
    "date date, effect_abs double, effect_rel double, ci_low double, ci_high double,"
    " p_value double, significant boolean,"
    " control struct<adders: bigint, orders: bigint, ccr: double>,"
    " treatment struct<adders: bigint, orders: bigint, ccr: double>"
)
_AUTH = (
    "struct<rate: double, ci_low: double, ci_high: double, authorized: bigint,"
    " total_attempts: bigint>"
)
_ORDER_VALUE = "struct<mean: double, count: bigint>"
GUARDRAILS_RECORD = (
    f"date date, payment_authorization struct<control: {_AUTH}, treatment: {_AUTH}>,"
    f" average_order_value struct<control: {_ORDER_VALUE}, treatment: {_ORDER_VALUE}>"
)
FUNNEL_ROW = (
    "variant string, adders bigint, begin_checkout bigint, payment_attempts bigint,"
    " orders bigint"
)


def ccr_records(events: EventTables) -> DataFrame:
    """The conversion summary with one nested record per variant."""
    arms = [
        F.struct(
            *[F.col(f"{v}_{name}").alias(name) for name in ("adders", "orders", "ccr")]
        ).alias(v)
        for v in VARIANTS
    ]
    return readout.ccr_summary(events).select(
        "date",
        "effect_abs",
        "effect_rel",
        "ci_low",
        "ci_high",
        "p_value",
        "significant",
        *arms,
    )


def guardrails_records(events: EventTables) -> DataFrame:
    """The guardrail summary nested by metric and variant."""
    rows = readout.guardrails_summary(events).select(
        "date",
        "variant",
        F.struct("rate", "ci_low", "ci_high", "authorized", "total_attempts").alias("auth"),
        F.struct(
            F.col("mean_order_value").alias("mean"), F.col("order_count").alias("count")
        ).alias("value"),
    )

    def nested(measure: str, name: str):
        return F.struct(*[F.col(f"{v}_{measure}").alias(v) for v in VARIANTS]).alias(name)

    return side_by_side(rows, ["date"], ["auth", "value"]).select(
        "date",
        nested("auth", "payment_authorization"),
        nested("value", "average_order_value"),
    )


def save_results(
    events: EventTables,
    folder: str,
    run_at: dt.datetime,
    revision: str | None = None,
    seed: int | None = None,
) -> None:
    """Write run metadata, both summaries and the funnel of the newest day."""
    metadata = readout.run_metadata(events, run_at, revision, seed)
    sinks.write_json(metadata, f"{folder}/_run_meta")
    sinks.write_json(ccr_records(events), f"{folder}/ccr_summary")
    sinks.write_json(guardrails_records(events), f"{folder}/guardrails_summary")
    sinks.write_csv(metrics.variant_funnel(events), f"{folder}/variant_funnel")


def build_marts(events: EventTables, database: str, buckets: int = 1024) -> None:
    """Materialize the three marts, bucketed by the key later joins use."""
    for name, df, key in (
        ("fct_experiments", marts.experiments(events), "user_id"),
        ("fct_checkout_steps", marts.checkout_steps(events), "checkout_id"),
        ("fct_orders", marts.orders(events), "checkout_id"),
    ):
        sinks.save_mart(df, f"{database}.{name}", key, buckets)
