"""Time-zone-free clock arithmetic on ``timestamp_ntz`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_minutes(ts: Column) -> Column:
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 1440 + F.hour(ts) * 60 + F.minute(ts)


def epoch_seconds(ts: Column) -> Column:
    return epoch_minutes(ts) * 60 + F.second(ts)


def epoch_millis(ts: Column) -> Column:
    second = F.extract(F.lit("SECOND"), ts)
    return epoch_minutes(ts) * 60_000 + F.floor(second * 1000).cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    """Clock seconds to the millisecond, so that distinct values stay bounded."""
    return (epoch_millis(end) - epoch_millis(start)) / F.lit(1000.0)
