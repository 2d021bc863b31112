"""Which rows belong to an analysis day.

``partition`` days follow the partition column, the day a funnel started. ``event``
days follow each event's own timestamp. They differ for funnels that cross midnight.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.sources.contract import EventTables

PARTITION = "partition"
EVENT = "event"


def most_recent_date(events: EventTables) -> DataFrame:
    """The newest partition day with carts, and its number of cart rows."""
    carts = events.add_to_cart
    return (
        carts.where(F.col("date") == newest(events))
        .groupBy(F.col("date").alias("max_date"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def newest(events: EventTables) -> Column:
    """The newest cart day as a scalar subquery, so scans can prune partitions by it."""
    return events.add_to_cart.agg(F.max("date")).scalar()


def day_of(basis: str) -> Column:
    if basis == PARTITION:
        return F.col("date")
    if basis == EVENT:
        return F.to_date("timestamp")
    raise ValueError(f"unknown date basis {basis!r}")


def on_day(
    df: DataFrame,
    events: EventTables,
    basis: str,
    day: dt.date | str | None = None,
    spill_days: int | None = None,
) -> DataFrame:
    """Rows of one day; the newest cart day when ``day`` is None.

    Event days read every partition. A caller who vouches that no event is further from
    its partition's day than ``spill_days`` lets the scan skip the other partitions.
    """
    wanted = newest(events) if day is None else F.lit(day).cast("date")
    if basis == EVENT and spill_days is not None:
        near = [F.date_add(wanted, k) for k in range(-spill_days, spill_days + 1)]
        df = df.where(F.col("date").isin(*near))
    return df.where(day_of(basis) == wanted)
