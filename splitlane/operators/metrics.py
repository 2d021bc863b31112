"""Conversion, guardrail and funnel metrics per variant, day or segment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.formatting import settled
from splitlane.operators import marts
from splitlane.operators.dates import EVENT, PARTITION, day_of, on_day
from splitlane.sources.contract import VARIANTS, EventTables

Day = dt.date | str | None


def pct(part: Column, whole: Column, places: int = 1) -> Column:
    return settled(F.try_divide(part * F.lit(100.0), whole), places)


def zero_if_absent(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def distinct_per(df: DataFrame, by: list[str | Column], key: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(key).alias(name))


def user_days(
    events: EventTables, day: Day = None, all_days: bool = True, timed: bool = False
) -> DataFrame:
    """One row per (partition day, user, variant) with a cart; did they order that day?

    Carts and orders meet in one aggregation instead of a join of two distinct sets,
    so the unit table costs a single shuffle of pre-combined rows. ``timed`` adds
    ``first_cart_at``.
    """
    keys = ["date", "user_id", "variant"]
    carts, orders = events.add_to_cart, events.order_completed
    if not all_days:
        carts = on_day(carts, events, PARTITION, day)
        orders = on_day(orders, events, PARTITION, day)
    cart_time = F.when(F.col("_added"), F.col("timestamp"))
    extra = [F.min(cart_time).alias("first_cart_at")] if timed else []
    # An order without a variant or user matches no cart.
    matched = F.col("variant").isNotNull() & F.col("user_id").isNotNull()
    columns = [*keys, *(["timestamp"] if timed else [])]
    touches = carts.select(
        *columns, F.lit(True).alias("_added"), F.lit(False).alias("_ordered")
    ).unionAll(
        orders.select(*columns, F.lit(False).alias("_added"), matched.alias("_ordered"))
    )
    return (
        touches.groupBy(*keys)
        .agg(
            F.max("_added").alias("_added"),
            F.max("_ordered").alias("converted"),
            *extra,
        )
        .where("_added")
        .drop("_added")
    )


def require_both_variants(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The grouped ``cells`` unchanged, or a failure where a group lacks a variant.

    For metrics that must not be read off one arm alone. An empty frame has no group,
    so it passes. The window runs over a few rows per group.
    """
    group = Window.partitionBy(*(by or []))
    found = [F.count_if(F.col("variant") == v).over(group) > 0 for v in VARIANTS]
    fault = F.raise_error(F.lit("a group of the metric lacks a variant"))
    checked = F.when(found[0] & found[1], F.col("variant")).otherwise(fault)
    return cells.withColumn("variant", checked)


def conversions(units: DataFrame, by: list[str]) -> DataFrame:
    """Adders and orderers of a unit table per group."""
    return units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("adders"),
        F.sum(F.col("converted").cast("bigint")).alias("orders"),
    )


def stacked(frames: list[DataFrame], keys: list[str], counts: list[str]) -> DataFrame:
    """Grouped frames with some of the ``counts`` each, side by side; absent counts are 0.

    A key of any frame is kept, and one without a value is a key like any other: the few
    grouped rows meet in one union and one aggregation, not in joins.
    """
    whole = None
    for frame in frames:
        there = [F.col(c) if c in frame.columns else F.lit(0).cast("bigint").alias(c) for c in counts]
        part = frame.select(*keys, *there)
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def ccr_same_day(events: EventTables) -> DataFrame:
    """Bounded conversion per day and variant: orderers are a subset of adders."""
    return conversions(user_days(events), ["date", "variant"])


def ccr_first_exposure(events: EventTables, basis: str = EVENT) -> DataFrame:
    """Users first exposed on a day against everyone who ordered that day.

    Nothing ties orderers to the exposed cohort: with returning users a day can have
    more orders than adders. Every day and variant with carts or orders has a row, also
    where nobody was first exposed.
    """
    by = [day_of(basis).alias("date"), "variant"]
    adders = (
        marts.experiments(events)
        .groupBy(F.to_date("first_exposed_at").alias("date"), "variant")
        .agg(F.count("user_id").alias("adders"))
    )
    orderers = distinct_per(events.order_completed, by, "user_id", "orders")
    seen = events.add_to_cart.select(*by).distinct()
    return stacked([adders, orderers, seen], ["date", "variant"], ["adders", "orders"])


def ccr_compact(events: EventTables, day: Day = None) -> DataFrame:
    """Distinct adders and orderers of one partition day, with the rounded rate."""
    adders = distinct_per(
        on_day(events.add_to_cart, events, PARTITION, day), ["variant"], "user_id", "adders"
    )
    orders = distinct_per(
        on_day(events.order_completed, events, PARTITION, day),
        ["variant"],
        "user_id",
        "orders",
    )
    return (
        adders.join(orders, "variant", "left")
        .select("variant", "adders", zero_if_absent("orders"))
        .withColumn(
            "conditional_conversion_pct", pct(F.col("orders"), F.col("adders"))
        )
        .orderBy("variant")
    )


def ccr_window(events: EventTables) -> DataFrame:
    """Conversion over the whole experiment window."""
    adders = (
        marts.experiments(events)
        .groupBy("variant")
        .agg(F.count("user_id").alias("adders"))
    )
    orderers = distinct_per(events.order_completed, ["variant"], "user_id", "orderers")
    return (
        adders.join(orderers, "variant", "left")
        .select("variant", "adders", zero_if_absent("orderers"))
        .withColumn("conv_rate", pct(F.col("orderers"), F.col("adders")))
    )


def ccr_rollup(events: EventTables) -> DataFrame:
    """Daily rows and a whole-window row per variant, users counted once in each.

    The day is grouped as text because the total row needs a name of its own.
    """
    units = user_days(events).withColumn("scope", F.col("date").cast("string"))
    scope, variant, user = F.col("scope"), F.col("variant"), F.col("user_id")
    per_user = units.groupingSets(
        [[scope, variant, user], [variant, user]], scope, variant, user
    ).agg(
        F.grouping("scope").alias("_total"), F.max("converted").alias("converted")
    )
    named = per_user.withColumn(
        "scope", F.when(F.col("_total") == 1, "total").otherwise(F.col("scope"))
    )
    return conversions(named, ["scope", "variant"]).withColumn(
        "ccr", F.try_divide(F.col("orders"), F.col("adders"))
    )


def payment_totals(payments: DataFrame, by: list[str | Column]) -> DataFrame:
    return payments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(F.col("authorized")).alias("authorized"),
    )


def order_totals(orders: DataFrame, by: list[str | Column]) -> DataFrame:
    return orders.groupBy(*by).agg(
        F.count(F.lit(1)).alias("order_count"), F.avg("order_value").alias("aov")
    )


def _guardrail_cells(payments: DataFrame, orders: DataFrame, by: list[str | Column]) -> DataFrame:
    """Payments and orders of every group that has either, in one aggregation.

    ``missing`` says what a group lacks; its counts are 0 and its rate or mean is NULL.
    """
    names = [c if isinstance(c, str) else "date" for c in by]
    touches = payments.select(
        *by,
        F.lit(1).alias("_paid"),
        F.col("authorized").alias("_authorized"),
        F.lit(0).alias("_ordered"),
        F.lit(None).cast("double").alias("_value"),
    ).unionAll(
        orders.select(*by, F.lit(0), F.lit(False), F.lit(1), F.col("order_value").cast("double"))
    )
    cells = touches.groupBy(*names).agg(
        F.sum("_paid").alias("total_attempts"),
        F.count_if((F.col("_paid") == 1) & F.col("_authorized")).alias("authorized"),
        F.sum("_ordered").alias("order_count"),
        F.avg("_value").alias("aov"),
    )
    lacks = {"total_attempts": "payments", "order_count": "orders"}
    missing = F.concat_ws(", ", *[F.when(F.col(c) == 0, text) for c, text in lacks.items()])
    return cells.select(
        *names,
        "total_attempts",
        "authorized",
        F.try_divide(F.col("authorized"), F.col("total_attempts")).alias("auth_rate"),
        "order_count",
        "aov",
        F.nullif(missing, F.lit("")).alias("missing"),
    )


def guardrails(
    events: EventTables, day: Day = None, spill_days: int | None = None
) -> DataFrame:
    """Payment authorization and order value per variant on one event day.

    A variant with payments or orders that day has a row. ``spill_days`` lets scans prune
    partitions, see ``on_day``.
    """
    return _guardrail_cells(
        on_day(events.payment_attempt, events, EVENT, day, spill_days),
        on_day(events.order_completed, events, EVENT, day, spill_days),
        ["variant"],
    )


def guardrails_daily(events: EventTables, basis: str = EVENT) -> DataFrame:
    """The same for every day and variant with payments or orders."""
    by = [day_of(basis).alias("date"), "variant"]
    return _guardrail_cells(events.payment_attempt, events.order_completed, by)


def _rounded_guardrails(payments: DataFrame, orders: DataFrame, keys: list[str]):
    return payments.join(orders, keys).select(
        *keys,
        pct(F.col("authorized"), F.col("total_attempts")).alias("auth_rate_pct"),
        settled(F.col("aov"), 2).alias("avg_order_value"),
    )


def guardrails_compact(events: EventTables) -> DataFrame:
    """Rounded guardrails per partition day and variant having payments and orders."""
    keys = ["date", "variant"]
    return _rounded_guardrails(
        payment_totals(events.payment_attempt, keys),
        order_totals(events.order_completed, keys),
        keys,
    )


def guardrails_latest(events: EventTables) -> DataFrame:
    """Rounded guardrails of the newest partition day."""
    return _rounded_guardrails(
        payment_totals(on_day(events.payment_attempt, events, PARTITION), ["variant"]),
        order_totals(on_day(events.order_completed, events, PARTITION), ["variant"]),
        ["variant"],
    )


def outer_joined(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Grouped frames side by side; a key of any of them is kept."""
    joined, *others = frames
    for frame in others:
        joined = joined.join(frame, keys, "full")
    return joined


def summary_stats(events: EventTables) -> DataFrame:
    """Conversion counts next to guardrails, per event day and variant.

    A day and variant found in any table has a row; ``missing`` says what it lacks.
    """
    by = [day_of(EVENT).alias("date"), "variant"]
    exposed = (
        marts.experiments(events)
        .groupBy(F.to_date("first_exposed_at").alias("date"), "variant")
        .agg(F.count("user_id").alias("adders"))
    )
    joined = outer_joined(
        [
            exposed,
            distinct_per(events.order_completed, by, "user_id", "orders"),
            payment_totals(events.payment_attempt, by),
            order_totals(events.order_completed, by),
        ],
        ["date", "variant"],
    )
    counts = ("adders", "orders", "total_attempts", "authorized", "order_count")
    filled = joined.select("date", "variant", *map(zero_if_absent, counts), "aov")
    lacks = {
        "adders": "first exposures",
        "total_attempts": "payments",
        "order_count": "orders",
    }
    missing = F.concat_ws(
        ", ", *[F.when(F.col(name) == 0, text) for name, text in lacks.items()]
    )
    return filled.select(
        "date",
        "variant",
        *counts,
        F.try_divide(F.col("authorized"), F.col("total_attempts")).alias("auth_rate"),
        "aov",
        F.nullif(missing, F.lit("")).alias("missing"),
    )


def _funnel(events: EventTables, basis: str, day: Day) -> DataFrame:
    def rows(name: str) -> DataFrame:
        return on_day(events[name], events, basis, day)

    adders = distinct_per(rows("add_to_cart"), ["variant"], "user_id", "adders")
    begun = distinct_per(
        rows("begin_checkout"), ["variant"], "checkout_id", "begin_checkout"
    )
    payments = (
        rows("payment_attempt")
        .groupBy("variant")
        .agg(F.count(F.lit(1)).alias("payment_attempts"))
    )
    orders = (
        rows("order_completed").groupBy("variant").agg(F.count(F.lit(1)).alias("orders"))
    )
    stages = ["adders", "begin_checkout", "payment_attempts", "orders"]
    return stacked([adders, begun, payments, orders], ["variant"], stages).orderBy("variant")


def variant_funnel(events: EventTables, day: Day = None) -> DataFrame:
    """Four funnel stages per variant on one event day; a variant found in any has a row."""
    return _funnel(events, EVENT, day)


def funnel_summary(events: EventTables, day: Day = None) -> DataFrame:
    """Four funnel stages of one partition day; the rate counts orders by row."""
    return _funnel(events, PARTITION, day).withColumn(
        "conditional_conversion_pct", pct(F.col("orders"), F.col("adders"))
    )


def event_counts_by_date(events: EventTables) -> DataFrame:
    """Rows per day, one column per event table."""
    counts = None
    for name, df in events.items():
        part = (
            df.groupBy("date")
            .agg(F.count(F.lit(1)).alias("cnt"))
            .withColumn("event_type", F.lit(name))
        )
        counts = part if counts is None else counts.unionByName(part)
    names = [name for name, _ in events.items()]
    table = counts.groupBy("date").pivot("event_type", names).sum("cnt").fillna(0)
    return table.orderBy("date")


def exposure_overview(events: EventTables, rsd: float | None = None) -> DataFrame:
    """Users and variants; ``rsd`` asks for approximate user counts of that error."""
    users = F.approx_count_distinct("user_id", rsd) if rsd else F.count_distinct("user_id")
    return marts.experiments(events).agg(
        users.alias("total_users"),
        F.count_distinct("variant").alias("variants"),
    )


def share_of_total(counts: DataFrame, count: str, name: str, places: int) -> DataFrame:
    """Each row's percentage of the column total; for short, already grouped frames."""
    total = F.sum(count).over(Window.partitionBy())
    return counts.withColumn(name, pct(F.col(count), total, places))


def variant_balance_latest(events: EventTables) -> DataFrame:
    users = distinct_per(
        on_day(events.add_to_cart, events, PARTITION), ["variant"], "user_id", "users"
    )
    return share_of_total(users, "users", "pct", 1)


def payment_step_views(events: EventTables, day: Day = None) -> DataFrame:
    views = events.checkout_step_view.where(F.col("step_name") == "payment")
    return on_day(views, events, PARTITION, day)


def payment_latency(events: EventTables, day: Day = None) -> DataFrame:
    """One row of payment-step latency statistics for a day."""
    ms = F.col("latency_ms")
    return payment_step_views(events, day).agg(
        F.count(ms).alias("n"),
        F.avg(ms).alias("mean_ms"),
        F.percentile(ms, F.lit(0.5)).alias("median_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.stddev_samp(ms).alias("std_ms"),
    )


def latency_frequency(events: EventTables, day: Day = None) -> DataFrame:
    """How many payment-step views took each latency."""
    return (
        payment_step_views(events, day)
        .where(F.col("latency_ms").isNotNull())
        .groupBy("latency_ms")
        .agg(F.count(F.lit(1)).alias("views"))
    )


def latency_histogram(
    events: EventTables, bins: int = 30, day: Day = None
) -> DataFrame:
    """Equal-width bins between the day's extremes; the last bin is closed.

    Empty bins are not listed. A single-valued day falls into bin 0. The extremes are
    taken over the frequency table, which is as short as there are whole milliseconds.
    """
    everything = Window.partitionBy()
    low, high = (f("latency_ms").over(everything) for f in (F.min, F.max))
    width = (F.col("_high") - F.col("_low")).cast("double") / bins
    position = F.floor(F.try_divide(F.col("latency_ms") - F.col("_low"), F.col("_width")))
    index = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        latency_frequency(events, day)
        .withColumns({"_low": low, "_high": high})
        .withColumn("_width", width)
        .withColumn("bin", index)
        .groupBy("bin", "_low", "_width")
        .agg(F.sum("views").alias("views"))
        .select(
            "bin",
            (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"),
            (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("bin_end"),
            "views",
        )
    )


def cart_to_checkout(events: EventTables, floor: float = 0.60) -> DataFrame:
    """Begun checkouts per cart row, and whether it falls below the warning level."""
    counts = (
        events.add_to_cart.select(F.lit(1).alias("_cart"), F.lit(0).alias("_begin"))
        .unionAll(events.begin_checkout.select(F.lit(0), F.lit(1)))
        .agg(
            F.sum("_cart").alias("add_to_cart"), F.sum("_begin").alias("begin_checkout")
        )
    )
    rate = F.try_divide(F.col("begin_checkout"), F.col("add_to_cart"))
    return counts.withColumn("rate", rate).withColumn("below_floor", F.col("rate") < floor)
