"""Derive the six event tables from one generic activity log.

The log has ``event_id, ts, user_id, event_type, value, props`` where ``props`` is a
JSON object with an integer ``k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitlane.functions.assignment import assign_variant
from splitlane.sources.contract import (
    ERROR_CODES,
    PAYMENT_METHODS,
    STEP_NAMES,
    EventTables,
)


def _pick(index: str, names: tuple[str, ...], alias: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names))
    return f"CASE {index} {cases} END AS {alias}"


def events_from_activity_log(log: DataFrame) -> EventTables:
    log = log.selectExpr(
        "event_id",
        "event_type",
        "value",
        "CAST(user_id AS STRING) AS user_id",
        "concat_ws(':', user_id, to_date(ts)) AS checkout_id",
        "ts AS timestamp",
        "to_date(ts) AS date",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k",
    ).withColumn("variant", assign_variant("user_id"))

    def of(condition: str, *columns: str) -> DataFrame:
        return log.where(condition).selectExpr(*columns)

    return EventTables(
        add_to_cart=of(
            "event_type = 'view'",
            "user_id",
            "checkout_id AS session_id",
            "timestamp",
            "value AS cart_value",
            "k % 10 + 1 AS items_count",
            "variant",
            "date",
        ),
        begin_checkout=of(
            "event_type = 'click'",
            "user_id",
            "checkout_id",
            "timestamp",
            "variant",
            "date",
        )
        .groupBy("user_id", "checkout_id", "variant", "date")
        .agg({"timestamp": "min"})
        .withColumnRenamed("min(timestamp)", "timestamp"),
        checkout_step_view=of(
            "event_type = 'signup'",
            "checkout_id",
            _pick("k % 4", STEP_NAMES, "step_name"),
            "k % 4 AS step_index",
            "timestamp",
            "variant",
            "floor(value * 20) + 200 AS latency_ms",
            "date",
        ),
        form_error=of(
            "event_type = 'error'",
            "checkout_id",
            _pick("k % 4", STEP_NAMES, "step_name"),
            "concat('f', k % 5) AS field_name",
            _pick("k % 3", ERROR_CODES, "error_code"),
            "timestamp",
            "variant",
            "date",
        ),
        payment_attempt=of(
            "event_type = 'purchase'",
            "checkout_id",
            _pick("k % 2", PAYMENT_METHODS, "payment_method"),
            "k % 10 <> 0 AS authorized",
            "timestamp",
            "variant",
            "date",
        ),
        order_completed=of(
            "event_type = 'purchase' AND k % 10 <> 0",
            "CAST(event_id AS STRING) AS order_id",
            "checkout_id",
            "user_id",
            "timestamp",
            "value AS order_value",
            "'USD' AS currency",
            "variant",
            "date",
        ),
    )


def read_activity_log(spark: SparkSession, sf_dir: str) -> EventTables:
    return events_from_activity_log(spark.read.parquet(f"{sf_dir}/events.parquet"))
