"""Daily sketches that roll up to any window without reading the events again.

A day's distinct users are a HyperLogLog sketch and its latencies a KLL quantile sketch,
both a few kilobytes whatever the traffic. They are written once per day; a window merges
the sketches of its days, so its cost depends on days and variants only.
"""

from __future__ import annotations

import datetime as dt
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.sources.contract import EventTables

#: 2**14 registers.
REGISTERS_LOG2 = 14
#: One standard error of a distinct count, as a share of it.
USERS_ERROR = 1.04 / math.sqrt(2**REGISTERS_LOG2)
#: Accuracy of the quantile sketch, and the error in rank that it keeps with 99 per cent
#: confidence (the library's documented figure for this accuracy).
KLL_K = 400
RANK_ERROR = 0.0073
QUANTILES = (0.5, 0.95, 0.99)


class Sketches(NamedTuple):
    """``users``: one sketch per day, variant and kind; ``latency``: per day, variant and step."""

    users: DataFrame
    latency: DataFrame


def daily_sketches(events: EventTables) -> Sketches:
    """Sketches of every partition day: users with carts and with orders, latencies by step."""
    touches = events.add_to_cart.select("date", "variant", "user_id", F.lit("adders").alias("kind")).unionAll(
        events.order_completed.select("date", "variant", "user_id", F.lit("orderers"))
    )
    users = touches.groupBy("date", "variant", "kind").agg(F.hll_sketch_agg("user_id", REGISTERS_LOG2).alias("sketch"))
    latency = (
        events.checkout_step_view.where(F.col("latency_ms").isNotNull())
        .groupBy("date", "variant", "step_name")
        .agg(F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), KLL_K).alias("sketch"))
    )
    return Sketches(users, latency)


def store_sketches(events: EventTables, folder: str, days: list[dt.date] | None = None) -> None:
    """Writes the sketches by day; only days that are written are replaced.

    With ``days`` only their partitions are read and written, as each day's run does.
    """
    chosen = events
    if days is not None:
        chosen = EventTables(**{name: df.where(F.col("date").isin(days)) for name, df in events.items()})
    for name, df in daily_sketches(chosen)._asdict().items():
        (
            df.repartition("date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date")
            .parquet(f"{folder}/{name}")
        )


def read_sketches(spark: SparkSession, folder: str) -> Sketches:
    return Sketches(*(spark.read.parquet(f"{folder}/{name}") for name in Sketches._fields))


def _in_window(df: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    if first is not None:
        df = df.where(F.col("date") >= F.lit(first))
    if last is not None:
        df = df.where(F.col("date") <= F.lit(last))
    return df


def window_users(sketches: Sketches, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Distinct adders and orderers per variant over the days from ``first`` to ``last``.

    A user of several days counts once. The error is about ``USERS_ERROR`` of the count.
    """
    merged = _in_window(sketches.users, first, last).groupBy("variant", "kind").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users")
    )

    def pick(kind: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("users"))), F.lit(0)).alias(kind)

    return merged.groupBy("variant").agg(pick("adders"), pick("orderers"))


def window_latency(sketches: Sketches, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Latency quantiles per step and variant over the window, within ``RANK_ERROR`` in rank."""
    merged = _in_window(sketches.latency, first, last).groupBy("step_name", "variant").agg(
        F.kll_merge_agg_bigint("sketch").alias("_sketch")
    )
    return merged.select(
        "step_name",
        "variant",
        F.kll_sketch_get_n_bigint("_sketch").alias("views"),
        *[F.kll_sketch_get_quantile_bigint("_sketch", F.lit(q)).alias(f"p{round(100 * q)}") for q in QUANTILES],
    )


def rollup_check(events: EventTables, sketches: Sketches, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Exact figures of a window, and whether the sketches' stay within their error.

    Distinct counts are held to four standard errors (one user at least), quantiles by the
    share of views below and up to them, to twice ``RANK_ERROR`` and one view.
    """
    exact_users = None
    for kind, table in (("adders", events.add_to_cart), ("orderers", events.order_completed)):
        part = _in_window(table, first, last).groupBy("variant").agg(F.count_distinct("user_id").alias("exact"))
        part = part.select(F.lit(kind).alias("measure"), "variant", "exact")
        exact_users = part if exact_users is None else exact_users.unionByName(part)
    estimates = window_users(sketches, first, last)
    listed = estimates.select(
        "variant",
        F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("estimate")) for k in ("adders", "orderers")])),
    )
    users = exact_users.join(listed, ["measure", "variant"], "left").select(
        "measure",
        "variant",
        "exact",
        (F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.col("exact") * 4 * USERS_ERROR, F.lit(1.0))).alias("within_error"),
    )
    views = _in_window(events.checkout_step_view, first, last).where(F.col("latency_ms").isNotNull())
    names = [f"p{round(100 * q)}" for q in QUANTILES]
    quantiles = window_latency(sketches, first, last).drop("views")
    ranked = views.join(F.broadcast(quantiles), ["step_name", "variant"])  # one row per step and variant
    counts = ranked.groupBy("step_name", "variant").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("latency_ms") < F.col(p)).alias(f"below_{p}") for p in names],
        *[F.count_if(F.col("latency_ms") <= F.col(p)).alias(f"upto_{p}") for p in names],
    )
    n = F.col("n")
    fits = [
        (F.col(f"below_{p}") <= n * (q + 2 * RANK_ERROR) + 1) & (F.col(f"upto_{p}") >= n * (q - 2 * RANK_ERROR) - 1)
        for p, q in zip(names, QUANTILES, strict=True)
    ]
    latency = counts.select(
        F.concat(F.lit("latency: "), F.col("step_name")).alias("measure"),
        "variant",
        n.alias("exact"),
        (fits[0] & fits[1] & fits[2]).alias("within_error"),
    )
    return users.unionByName(latency)
