"""Small hand-written event tables."""

from __future__ import annotations

import datetime as dt

from splitlane.sources.contract import EVENT_NAMES, RAW_SCHEMAS, EventTables
from splitlane.sources.lake import parse_timestamps

DAY = dt.date(2025, 1, 1)
NEXT = dt.date(2025, 1, 2)


def tables(spark, **rows) -> EventTables:
    """Event tables from lists of tuples in contract column order; others stay empty."""
    return EventTables(
        **{
            name: parse_timestamps(
                spark.createDataFrame(rows.get(name, []), RAW_SCHEMAS[name])
            )
            for name in EVENT_NAMES
        }
    )


def cart(user, at, variant="control", date=DAY, session=None):
    return (user, session or f"s-{user}", at, 10.0, 1, variant, date)


def begin(user, checkout, at, variant="control", date=DAY):
    return (user, checkout, at, variant, date)


def view(checkout, step, index, at, latency, variant="control", date=DAY):
    return (checkout, step, index, at, variant, latency, date)


def error(checkout, step, at, code="invalid", field="f0", variant="control", date=DAY):
    return (checkout, step, field, code, at, variant, date)


def payment(checkout, authorized, at, variant="control", date=DAY, method="card"):
    return (checkout, method, authorized, at, variant, date)


def order(order_id, checkout, user, at, value=10.0, variant="control", date=DAY):
    return (order_id, checkout, user, at, value, "USD", variant, date)


def records(df):
    return [row.asDict(recursive=True) for row in df.collect()]


def one(df):
    (row,) = records(df)
    return row
