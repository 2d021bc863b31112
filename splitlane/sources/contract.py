"""The event contract: column types, allowed values and the six-table bundle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

# The tracking contract's enum members and step order.
VARIANTS = ("control", "treatment")
STEP_NAMES = ("address", "shipping", "payment", "review")
PAYMENT_METHODS = ("card", "paypal")
ERROR_CODES = ("invalid", "declined", "timeout")

EVENT_NAMES = (
    "add_to_cart",
    "begin_checkout",
    "checkout_step_view",
    "form_error",
    "payment_attempt",
    "order_completed",
)


# Timestamps arrive as ISO-8601 text and are parsed by the reader. `date` is the
# partition column: the day a funnel started, which is not always the event's day.
RAW_SCHEMAS: dict[str, str] = {
    "add_to_cart": (
        "user_id string, session_id string, timestamp string, cart_value double,"
        " items_count bigint, variant string, date date"
    ),
    "begin_checkout": (
        "user_id string, checkout_id string, timestamp string, variant string, date date"
    ),
    "checkout_step_view": (
        "checkout_id string, step_name string, step_index bigint, timestamp string,"
        " variant string, latency_ms bigint, date date"
    ),
    "form_error": (
        "checkout_id string, step_name string, field_name string, error_code string,"
        " timestamp string, variant string, date date"
    ),
    "payment_attempt": (
        "checkout_id string, payment_method string, authorized boolean,"
        " timestamp string, variant string, date date"
    ),
    "order_completed": (
        "order_id string, checkout_id string, user_id string, timestamp string,"
        " order_value double, currency string, variant string, date date"
    ),
}

# Enum columns the standing quality gate looks at.
GATE_ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("checkout_step_view", "step_name"): STEP_NAMES,
    ("add_to_cart", "variant"): VARIANTS,
    ("begin_checkout", "variant"): VARIANTS,
    ("checkout_step_view", "variant"): VARIANTS,
    ("order_completed", "variant"): VARIANTS,
}

# Every enum column of the contract.
CONTRACT_ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    **{(name, "variant"): VARIANTS for name in EVENT_NAMES},
    ("checkout_step_view", "step_name"): STEP_NAMES,
    ("form_error", "step_name"): STEP_NAMES,
    ("form_error", "error_code"): ERROR_CODES,
    ("payment_attempt", "payment_method"): PAYMENT_METHODS,
}


@dataclass(frozen=True)
class EventTables:
    """The six event tables an analysis reads, with parsed timestamps."""

    add_to_cart: DataFrame
    begin_checkout: DataFrame
    checkout_step_view: DataFrame
    form_error: DataFrame
    payment_attempt: DataFrame
    order_completed: DataFrame

    def __getitem__(self, name: str) -> DataFrame:
        if name not in EVENT_NAMES:
            raise KeyError(name)
        return getattr(self, name)

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        return ((name, self[name]) for name in EVENT_NAMES)
