"""Secondary metrics and diagnostics of the funnel, by variant, step, time or segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.clock import seconds_between
from splitlane.functions.inference import chi_square_even_split
from splitlane.functions.normal import two_sided_p
from splitlane.operators.dates import EVENT
from splitlane.operators.guardrails import evaluate
from splitlane.operators.metrics import (
    conversions,
    guardrails_daily,
    outer_joined,
    user_days,
    zero_if_absent,
)
from splitlane.operators.quality import side_by_side
from splitlane.operators.readout import tested_cells, two_proportion_daily
from splitlane.operators.skew import exact_percentiles, with_neighbour
from splitlane.sources.contract import EventTables

SLOW_MS = 3000
TIMEOUT_MS = 10_000


def _rate(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


def _rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def checkout_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per (checkout, variant): in how many rows of each table it occurs.

    One aggregation over the tables replaces a chain of joins: rows combine per
    checkout before the shuffle and meet in it once.
    """
    out = None
    for name, df in tables.items():
        part = df.select(
            "checkout_id",
            "variant",
            *[F.lit(int(flag == name)).cast("bigint").alias(flag) for flag in tables],
        )
        out = part if out is None else out.unionByName(part)
    return out.groupBy("checkout_id", "variant").agg(
        *[F.sum(flag).alias(flag) for flag in tables]
    )


# --- conversion and funnel -------------------------------------------------------


def gross_conversion(events: EventTables) -> DataFrame:
    """Sessions with a cart whose user ordered on the session's day, per variant.

    Sessions without a user or variant count, and converted never. Only user-days that
    ordered are looked up; a user owning very many sessions is a skewed join side,
    which adaptive execution splits.
    """
    unit = ["date", "user_id", "variant"]
    sessions = events.add_to_cart.select("session_id", *unit).distinct()
    bought = events.order_completed.select(*unit).distinct()
    marked = sessions.join(bought.withColumn("_bought", F.lit(True)), unit, "left")
    per_session = marked.groupBy("session_id", "variant").agg(
        F.count("_bought").alias("_bought")
    )
    return (
        per_session.groupBy("variant")
        .agg(_rows("sessions"), F.count_if(F.col("_bought") > 0).alias("converted_sessions"))
        .withColumn("gross_conversion", _rate("converted_sessions", "sessions"))
    )


def step_through(events: EventTables) -> DataFrame:
    """Stage-to-stage rates per day and variant, and the stage losing most.

    A day and variant seen at any stage has a row. All stages are counted in one
    aggregation of one union.
    """
    by = ["date", "variant"]
    stages = {
        "adders": (events.add_to_cart, "user_id"),
        "begun": (events.begin_checkout, "checkout_id"),
        "paid": (events.payment_attempt, "checkout_id"),
        "ordered": (events.order_completed, "checkout_id"),
    }
    touches = None
    for name, (df, key) in stages.items():
        part = df.select(*by, F.lit(name).alias("_stage"), F.col(key).alias("_key"))
        touches = part if touches is None else touches.unionAll(part)
    distinct = touches.groupBy(*by, "_stage").agg(F.count_distinct("_key").alias("_n"))
    counted = (
        distinct.groupBy(*by)
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("_stage") == s, F.col("_n"))), F.lit(0)).alias(s)
                for s in stages
            ]
        )
        .withColumns(
            {
                "cart_to_begin": _rate("begun", "adders"),
                "begin_to_payment": _rate("paid", "begun"),
                "payment_to_order": _rate("ordered", "paid"),
            }
        )
    )
    rates = ("cart_to_begin", "begin_to_payment", "payment_to_order")
    worst = F.least(*rates)
    named = F.coalesce(*[F.when(F.col(r) == worst, F.lit(r)) for r in rates])
    return counted.withColumn("largest_drop", named)


def step_abandonment(events: EventTables) -> DataFrame:
    """Where checkouts without an order stopped: furthest step seen, per variant."""
    furthest = events.checkout_step_view.groupBy("checkout_id", "variant").agg(
        F.max("step_index").alias("step_index")
    )
    bought = events.order_completed.select("checkout_id").distinct()
    lost = (
        furthest.join(bought, "checkout_id", "left_anti")
        .groupBy("variant", "step_index")
        .agg(_rows("abandoned"))
    )
    total = F.sum("abandoned").over(Window.partitionBy("variant"))
    return lost.withColumn("share", F.try_divide(F.col("abandoned"), total))


def segment_cut(units: DataFrame, segment: str, alpha: float = 0.05) -> DataFrame:
    """Conversion lift and test within each value of any segment column."""
    return tested_cells(conversions(units, [segment, "variant"]), [segment], alpha)


def new_or_returning(events: EventTables) -> DataFrame:
    """User-days marked ``new`` on the user's first cart day, else ``returning``."""
    # A user has at most one unit per day and variant, so the window stays short.
    first = F.min("date").over(Window.partitionBy("user_id"))
    return user_days(events).withColumn(
        "segment", F.when(F.col("date") == first, "new").otherwise("returning")
    )


def segment_lift(events: EventTables) -> DataFrame:
    return segment_cut(new_or_returning(events), "segment")


# --- errors ----------------------------------------------------------------------


def form_error_rate(events: EventTables) -> DataFrame:
    """Form errors per begun checkout, per variant."""
    errors = events.form_error.groupBy("variant").agg(_rows("errors"))
    begun = events.begin_checkout.groupBy("variant").agg(
        F.count_distinct("checkout_id").alias("checkouts")
    )
    return (
        begun.join(errors, "variant", "left")
        .select("variant", "checkouts", zero_if_absent("errors"))
        .withColumn("errors_per_checkout", _rate("errors", "checkouts"))
    )


def error_mix(events: EventTables, top: int = 10) -> DataFrame:
    """The most frequent (step, field) errors per variant with their share.

    The grouped frame has one row per form field, so ranking it is cheap.
    """
    counts = events.form_error.groupBy("variant", "step_name", "field_name").agg(
        _rows("errors")
    )
    whole = Window.partitionBy("variant")
    ranked = whole.orderBy(F.desc("errors"), "step_name", "field_name")
    return (
        counts.withColumns(
            {
                "share": F.try_divide(F.col("errors"), F.sum("errors").over(whole)),
                "rank": F.row_number().over(ranked),
            }
        ).where(F.col("rank") <= top)
    )


def multi_error_sessions(events: EventTables, threshold: int = 3) -> DataFrame:
    """Checkouts with errors: how many had several, and how many still ordered."""
    tables = {"failed": events.form_error, "ordered": events.order_completed}
    failed = checkout_counts(tables).where(F.col("failed") > 0)
    return (
        failed.groupBy("variant")
        .agg(
            _rows("checkouts_with_errors"),
            F.count_if(F.col("failed") >= threshold).alias("multi_error_checkouts"),
            F.count_if(F.col("ordered") > 0).alias("completed_despite_errors"),
        )
        .withColumn("multi_error_rate", _rate("multi_error_checkouts", "checkouts_with_errors"))
        .withColumn("completion_rate", _rate("completed_despite_errors", "checkouts_with_errors"))
    )


def error_sequences(events: EventTables) -> DataFrame:
    """How often an error follows another in the same checkout."""
    errors = events.form_error.select(
        "checkout_id", "timestamp", "step_name", "field_name", "error_code"
    ).withColumn("error", F.concat_ws(":", "step_name", "error_code"))
    linked = with_neighbour(
        errors,
        "checkout_id",
        "timestamp",
        ["step_name", "field_name", "error_code"],
        ["error"],
        "_before",
    )
    pairs = (
        linked.where(F.col("_before").isNotNull())
        .groupBy(F.col("_before.error").alias("previous_error"), "error")
        .agg(_rows("times"))
    )
    total = F.sum("times").over(Window.partitionBy())
    return pairs.withColumn("share", F.try_divide(F.col("times"), total))


# --- steps and time --------------------------------------------------------------


def step_backtracks(events: EventTables) -> DataFrame:
    """Step views that go back behind, or repeat, the previous step, per variant."""
    linked = with_neighbour(
        events.checkout_step_view,
        "checkout_id",
        "timestamp",
        ["step_index", "latency_ms"],
        ["step_index"],
        "_before",
    )
    before = F.col("_before.step_index")
    return (
        linked.groupBy("variant")
        .agg(
            _rows("views"),
            F.count_if(F.col("step_index") < before).alias("backtracks"),
            F.count_if(F.col("step_index") == before).alias("revisits"),
        )
        .withColumn("backtrack_rate", _rate("backtracks", "views"))
    )


def time_in_step(events: EventTables) -> DataFrame:
    """Median seconds until the checkout's next step view, by step and variant."""
    linked = with_neighbour(
        events.checkout_step_view,
        "checkout_id",
        "timestamp",
        ["step_index", "latency_ms"],
        ["timestamp"],
        "_next",
        ahead=True,
    ).where(F.col("_next").isNotNull())
    timed = linked.withColumn(
        "seconds", seconds_between(F.col("timestamp"), F.col("_next.timestamp"))
    )
    return exact_percentiles(
        timed,
        ["step_name", "variant"],
        "seconds",
        {"median_seconds": 0.5},
        extra={"transitions": F.sum("_n")},
    )


def completion_time(events: EventTables) -> DataFrame:
    """Median seconds from begin to first order, per variant.

    Both tables combine per checkout in one aggregation. Orders before their begin event
    have no duration and are counted as ``negative_spans``; checkouts with only one of the
    two events as ``unfinished`` and ``unbegun``.
    """
    begin = F.when(F.col("kind") == "begin", F.col("timestamp"))
    order = F.when(F.col("kind") == "order", F.col("timestamp"))
    spans = (
        events.begin_checkout.select(
            "checkout_id", "variant", "timestamp", F.lit("begin").alias("kind")
        )
        .unionAll(
            events.order_completed.select(
                "checkout_id", "variant", "timestamp", F.lit("order").alias("kind")
            )
        )
        .groupBy("checkout_id", "variant")
        .agg(F.min(begin).alias("_begin"), F.min(order).alias("_order"))
        .withColumn(
            "seconds",
            F.when(
                F.col("_order") >= F.col("_begin"),
                seconds_between(F.col("_begin"), F.col("_order")),
            ),
        )
        .withColumn(
            "_kind",
            F.when(F.col("_order").isNull(), "unfinished")
            .when(F.col("_begin").isNull(), "unbegun")
            .when(F.col("seconds").isNull(), "negative_spans")
            .otherwise("completed"),
        )
    )
    kinds = ("completed", "negative_spans", "unfinished", "unbegun")
    return (
        spans.groupBy("variant", "seconds", "_kind")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("variant")
        .agg(
            F.percentile(F.col("seconds"), F.lit(0.5), F.col("_n")).alias("median_seconds"),
            *[
                F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("_n"))), F.lit(0)).alias(k)
                for k in kinds
            ],
        )
    )


# --- latency ---------------------------------------------------------------------


def latency_percentiles(events: EventTables) -> DataFrame:
    """Latency percentiles and slow shares by step and variant."""
    ms, n = F.col("latency_ms"), F.col("_n")

    def share_over(limit: int) -> Column:
        return F.try_divide(F.sum(F.when(ms > limit, n).otherwise(0)), F.sum(n))

    return exact_percentiles(
        events.checkout_step_view.where(F.col("latency_ms").isNotNull()),
        ["step_name", "variant"],
        "latency_ms",
        {"p50": 0.5, "p95": 0.95, "p99": 0.99},
        extra={
            "max_ms": F.max(ms),
            "slow_share": share_over(SLOW_MS),
            "timeout_share": share_over(TIMEOUT_MS),
        },
    )


def latency_guardrail(events: EventTables) -> DataFrame:
    """The payment step's 95th percentile per day, judged by its guardrail rule."""
    views = events.checkout_step_view.where(F.col("step_name") == "payment")
    tails = exact_percentiles(views, ["date", "variant"], "latency_ms", {"p95": 0.95})
    wide = side_by_side(tails, ["date"], ["p95"]).select(
        "date",
        F.lit("payment_latency_p95").alias("metric"),
        F.col("control_p95").alias("baseline"),
        F.col("treatment_p95").alias("treatment"),
    )
    return evaluate(wide)


def latency_bucket(ms: Column) -> Column:
    return (
        F.when(ms < 1000, "under 1s")
        .when(ms < 2000, "1s to 2s")
        .when(ms <= SLOW_MS, "2s to 3s")
        .when(ms > SLOW_MS, "over 3s")
    )


def conversion_by_latency(events: EventTables) -> DataFrame:
    """Do checkouts with a slow page still order? By each checkout's slowest view."""
    slowest = events.checkout_step_view.groupBy("checkout_id").agg(
        F.max("latency_ms").alias("slowest")
    )
    bought = events.order_completed.select("checkout_id").distinct()
    return (
        slowest.join(bought.withColumn("_bought", F.lit(True)), "checkout_id", "left")
        .groupBy(latency_bucket(F.col("slowest")).alias("bucket"))
        .agg(_rows("checkouts"), F.count("_bought").alias("converted"))
        .withColumn("conversion", _rate("converted", "checkouts"))
    )


# --- payments --------------------------------------------------------------------


def auth_by_method(events: EventTables) -> DataFrame:
    """Authorization, decline and mix of payment methods per variant."""
    counts = events.payment_attempt.groupBy("payment_method", "variant").agg(
        _rows("attempts"), F.count_if("authorized").alias("authorized_attempts")
    )
    total = F.sum("attempts").over(Window.partitionBy("variant"))
    return counts.withColumns(
        {
            "auth_rate": _rate("authorized_attempts", "attempts"),
            "decline_rate": 1.0 - _rate("authorized_attempts", "attempts"),
            "mix": F.try_divide(F.col("attempts"), total),
        }
    )


def payment_retry_rate(events: EventTables) -> DataFrame:
    """Share of paying checkouts with two or more attempts, per variant."""
    per_checkout = events.payment_attempt.groupBy("checkout_id", "variant").agg(
        _rows("attempts")
    )
    return (
        per_checkout.groupBy("variant")
        .agg(_rows("checkouts"), F.count_if(F.col("attempts") >= 2).alias("retried"))
        .withColumn("retry_rate", _rate("retried", "checkouts"))
    )


# --- time of day -----------------------------------------------------------------


def _hourly_units(events: EventTables) -> DataFrame:
    """User-days with the hour of their first cart that day."""
    return user_days(events, timed=True).withColumn("hour", F.hour("first_cart_at"))


def ccr_by_hour(events: EventTables) -> DataFrame:
    """Conversion by hour of day of the first cart, per variant."""
    return conversions(_hourly_units(events), ["hour", "variant"]).withColumn(
        "ccr", _rate("orders", "adders")
    )


def traffic_by_hour(events: EventTables) -> DataFrame:
    """Checkout attempts and payments by hour of day; marks the busiest hour.

    An hour with begun checkouts, step views or payments has a row.
    """
    def by_hour(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.groupBy(F.hour("timestamp").alias("hour")).agg(*aggs)

    begun = by_hour(events.begin_checkout, _rows("checkouts"))
    latency = exact_percentiles(
        events.checkout_step_view.withColumn("hour", F.hour("timestamp")),
        ["hour"],
        "latency_ms",
        {"p50_ms": 0.5, "p95_ms": 0.95},
    )
    paid = by_hour(
        events.payment_attempt,
        _rows("attempts"),
        F.count_if("authorized").alias("authorized_attempts"),
    )
    busiest = Window.orderBy(F.desc("checkouts"), "hour")
    return (
        outer_joined([begun, latency, paid], ["hour"])
        .fillna(0, ["checkouts", "attempts", "authorized_attempts"])
        .withColumn("auth_rate", _rate("authorized_attempts", "attempts"))
        .withColumn("peak", F.row_number().over(busiest) == 1)
    )


def weekend_uplift(events: EventTables) -> DataFrame:
    """Weekend conversion over weekday conversion, per variant."""
    # weekday() counts from Monday = 0.
    weekend = F.weekday("date") >= 5
    units = user_days(events).withColumn("_weekend", weekend)

    def rate(which: Column) -> Column:
        bought = F.count_if(which & F.col("converted"))
        return F.try_divide(bought, F.count_if(which))

    return units.groupBy("variant").agg(
        rate(F.col("_weekend")).alias("weekend_ccr"),
        rate(~F.col("_weekend")).alias("weekday_ccr"),
    ).withColumn("weekend_uplift", _rate("weekend_ccr", "weekday_ccr"))


def ccr_by_weekday(events: EventTables) -> DataFrame:
    units = user_days(events).withColumn("weekday", F.weekday("date"))
    return conversions(units, ["weekday", "variant"]).withColumn(
        "ccr", _rate("orders", "adders")
    )


def srm_by_hour(events: EventTables, alpha: float = 0.05) -> DataFrame:
    """Is traffic split evenly? Chi-square per hour of day, and for all hours together."""
    cells = _hourly_units(events)
    hour = F.col("hour")
    split = (
        cells.groupingSets([[hour], []], hour)
        .agg(
            F.grouping("hour").alias("_all"),
            F.count_if(F.col("variant") == "control").alias("control_users"),
            F.count_if(F.col("variant") == "treatment").alias("treatment_users"),
        )
        .withColumn(
            "scope",
            F.when(F.col("_all") == 1, "all").otherwise(F.col("hour").cast("string")),
        )
    )
    chi = chi_square_even_split(F.col("control_users"), F.col("treatment_users"))
    return (
        split.select("scope", "control_users", "treatment_users", chi.alias("chi_square"))
        .withColumn("_z", F.sqrt("chi_square"))
        .withColumn("p_value", two_sided_p(F.col("_z")))
        .withColumn("mismatch", F.col("p_value") < alpha)
        .drop("_z")
    )


def hourly_variability(events: EventTables) -> DataFrame:
    """Mean and spread of checkouts begun per clock hour, per variant.

    Only hours with traffic count.
    """
    hourly = events.begin_checkout.groupBy(
        "variant", F.to_date("timestamp").alias("day"), F.hour("timestamp").alias("hour")
    ).agg(_rows("checkouts"))
    return hourly.groupBy("variant").agg(
        _rows("hours"),
        F.avg("checkouts").alias("mean_checkouts"),
        F.stddev_samp("checkouts").alias("std_checkouts"),
        F.max("checkouts").alias("peak_checkouts"),
    )


# --- monitoring ------------------------------------------------------------------


def rollback_monitor(
    events: EventTables, max_drop: float = 0.01, days: int = 3, min_auth: float = 0.90
) -> DataFrame:
    """Days on which conversion fell too far, and runs of them long enough to roll back.

    The daily frame has one row per day. Consecutive breach days share the day they
    would have started on, which numbers each run.
    """
    effects = two_proportion_daily(events).select("date", "effect_abs")
    auth = side_by_side(guardrails_daily(events, EVENT), ["date"], ["auth_rate"])
    daily = effects.join(auth, "date", "left").select(
        "date",
        "effect_abs",
        F.coalesce(F.col("effect_abs") < -max_drop, F.lit(False)).alias("breach"),
        F.coalesce(F.col("treatment_auth_rate") < min_auth, F.lit(False)).alias(
            "auth_breach"
        ),
    )
    in_order = Window.partitionBy("breach").orderBy("date")
    run = F.date_sub(F.col("date"), F.row_number().over(in_order))
    so_far = Window.partitionBy("breach", "_run").orderBy("date")
    length = F.when(F.col("breach"), F.row_number().over(so_far)).otherwise(0)
    return (
        daily.withColumn("_run", run)
        .withColumn("breach_days", length)
        .withColumn("rollback", F.col("breach_days") >= days)
        .drop("_run")
    )
