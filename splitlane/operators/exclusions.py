"""Traffic that a readout leaves out by stated rules: bots, staff, listed users.

Three of the event tables name the user, three only the checkout. An excluded user takes
along every checkout that any table ties to them, so that no funnel stage keeps rows whose
cart is gone. Tables are filtered by anti-joins on the few excluded keys, and adaptive
execution sees how few they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.sources.contract import EventTables

#: Carts of one user within one hour of the clock from which on it is no person.
BOT_CARTS = 30


def fast_users(events: EventTables, carts_per_hour: int = BOT_CARTS) -> DataFrame:
    """``user_id, reason`` of users with so many carts within one hour."""
    hourly = events.add_to_cart.groupBy("user_id", F.date_trunc("hour", "timestamp")).agg(F.count(F.lit(1)).alias("n"))
    return (
        hourly.where(F.col("user_id").isNotNull() & (F.col("n") >= carts_per_hour))
        .select("user_id")
        .distinct()
        .withColumn("reason", F.lit("bot"))
    )


def named_users(events: EventTables, rule: Column, reason: str) -> DataFrame:
    """``user_id, reason`` of users whose id a rule over ``user_id`` picks, such as staff accounts."""
    seen = [events[t].select("user_id") for t in ("add_to_cart", "begin_checkout", "order_completed")]
    every = reduce(DataFrame.unionByName, seen)
    return every.where(F.col("user_id").isNotNull() & rule).distinct().withColumn("reason", F.lit(reason))


def excluded_users(lists: Sequence[DataFrame]) -> DataFrame:
    """One row per excluded user, with all reasons in order."""
    return (
        reduce(DataFrame.unionByName, lists)
        .groupBy("user_id")
        .agg(F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reason"))
    )


def without_users(events: EventTables, excluded: DataFrame) -> EventTables:
    """The six tables without the excluded users and their checkouts.

    ``excluded`` has ``user_id``; rows without a user or a checkout stay, for nothing ties them to
    anybody. Names and columns are as before.
    """
    users = excluded.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    owned = events.begin_checkout.select("checkout_id", "user_id").unionByName(
        events.order_completed.select("checkout_id", "user_id")
    )
    checkouts = owned.join(users, "user_id", "left_semi").where(F.col("checkout_id").isNotNull()).select("checkout_id").distinct()
    out = {}
    for name, df in events.items():
        kept = df
        if "user_id" in df.columns:
            kept = kept.join(users, "user_id", "left_anti")
        if "checkout_id" in df.columns:
            kept = kept.join(checkouts, "checkout_id", "left_anti")
        out[name] = kept.select(df.columns)
    return EventTables(**out)


def exclusion_counts(events: EventTables, excluded: DataFrame) -> DataFrame:
    """Per table: rows, and rows that stay; what a readout should say about its traffic."""
    rest = without_users(events, excluded)
    out = None
    for name, df in events.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
            "kept", rest[name].agg(F.count(F.lit(1))).scalar()
        )
        part = part.select(F.lit(name).alias("table_name"), "rows", "kept")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("excluded", F.col("rows") - F.col("kept"))


def preset_exclusions(events: EventTables) -> DataFrame:
    """Fast users, and the accounts whose id ends in 7 as a stand-in for staff accounts."""
    return excluded_users(
        [fast_users(events, 2), named_users(events, F.col("user_id").endswith("7"), "staff")]
    )


def error_abandonment(events: EventTables) -> DataFrame:
    """Do checkouts with errors end without an order more often? Per variant, and over both.

    A checkout counts if it was begun or had an error. ``odds_ratio`` of abandoning with against
    without errors has half a checkout added to each cell where one is empty; its interval
    and test use the logarithm. ``phi`` is the correlation of the two yes-or-no facts.
    """
    touches = (
        events.begin_checkout.select("checkout_id", "variant", F.lit(1).alias("_counts"), F.lit(0).alias("_failed"), F.lit(0).alias("_bought"))
        .unionAll(events.form_error.select("checkout_id", "variant", F.lit(1), F.lit(1), F.lit(0)))
        .unionAll(events.order_completed.select("checkout_id", "variant", F.lit(0), F.lit(0), F.lit(1)))
    )
    checkouts = (
        touches.where(F.col("checkout_id").isNotNull())
        .groupBy("checkout_id", "variant")
        .agg(F.max("_counts").alias("counts"), F.max("_failed").alias("failed"), F.max("_bought").alias("bought"))
        .where("counts = 1")
    )
    variant, cell = F.col("variant"), {}
    for name, failed, bought in (("a", 1, 0), ("b", 1, 1), ("c", 0, 0), ("d", 0, 1)):
        cell[name] = F.count_if((F.col("failed") == failed) & (F.col("bought") == bought)).alias(name)
    table = (
        checkouts.groupingSets([[variant], []], variant)
        .agg(F.grouping("variant").alias("_all"), *cell.values())
        .where(F.col("a") + F.col("b") + F.col("c") + F.col("d") > 0)
    )
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    add = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    log_odds = F.log((a + add) * (d + add) / (b + add) / (c + add))
    error = F.sqrt(1.0 / (a + add) + 1.0 / (b + add) + 1.0 / (c + add) + 1.0 / (d + add))
    return table.withColumns({"_l": log_odds, "_e": error}).select(
        F.when(F.col("_all") == 1, "both").otherwise(variant).alias("variant"),
        (a + b).cast("bigint").alias("with_errors"),
        (c + d).cast("bigint").alias("without_errors"),
        F.try_divide(a, a + b).alias("abandoned_with"),
        F.try_divide(c, c + d).alias("abandoned_without"),
        F.exp("_l").alias("odds_ratio"),
        F.exp(F.col("_l") - 1.96 * F.col("_e")).alias("ci_low"),
        F.exp(F.col("_l") + 1.96 * F.col("_e")).alias("ci_high"),
        F.try_divide(F.col("_l"), F.col("_e")).alias("z"),
        F.try_divide(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d))).alias("phi"),
    )
