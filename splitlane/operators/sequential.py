"""Interim looks at a running experiment, which may stop it before its end.

A user counts from the day of the first cart, and as a buyer from the first day with an
order of a cart day. Totals up to each day are sums of new users and new buyers, so a look
never counts a user twice, and the days' totals are all that a look needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.assignment import salted_digest, variant_of_digest
from splitlane.functions.inference import two_proportion_test
from splitlane.functions.sequential import (
    SPENDING,
    always_valid_p,
    equal_looks,
    spending_boundaries,
)
from splitlane.operators.power import known_user_days
from splitlane.operators.quality import side_by_side
from splitlane.sources.contract import EventTables

#: Looks of the plan, one a day.
LOOKS = 30
#: Spread of the effects that the always-valid test looks for, in shares of users.
TAU = 0.02


def first_days(events: EventTables, keep: Sequence[str] = ("variant",)) -> DataFrame:
    """``joined`` and ``bought``: first cart day and first converted day of every user."""
    return (
        known_user_days(events)
        .groupBy("user_id", *keep)
        .agg(
            F.min("date").alias("joined"),
            F.min(F.when(F.col("converted"), F.col("date"))).alias("bought"),
        )
    )


def new_per_day(users: DataFrame, by: Sequence[str]) -> DataFrame:
    """New users and new buyers of every day."""
    steps = F.array(
        F.struct(F.col("joined").alias("date"), F.lit(1).alias("adders"), F.lit(0).alias("orders")),
        F.struct(F.col("bought").alias("date"), F.lit(0).alias("adders"), F.lit(1).alias("orders")),
    )
    return (
        users.select(*by, F.inline(steps))
        .where(F.col("date").isNotNull())
        .groupBy(*by, "date")
        .agg(F.sum("adders").alias("adders"), F.sum("orders").alias("orders"))
    )


def running_totals(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both variants' totals up to each day, and the number of the look."""
    wide = side_by_side(daily, [*by, "date"], ["adders", "orders"])
    until = Window.partitionBy(*by).orderBy("date")
    names = [f"{v}_{m}" for v in ("control", "treatment") for m in ("adders", "orders")]
    return wide.select(
        *by,
        "date",
        F.row_number().over(until).alias("look"),
        *[F.sum(F.coalesce(F.col(n), F.lit(0))).over(until).alias(n) for n in names],
    )


def tested_looks(totals: DataFrame, by: Sequence[str], alpha: float, tau: float) -> DataFrame:
    """Every look's test, with the smallest always-valid p-value up to it."""
    tested = two_proportion_test(
        totals, "control_orders", "control_adders", "treatment_orders", "treatment_adders", alpha
    )
    buyers, users = (F.col(f"control_{m}") + F.col(f"treatment_{m}") for m in ("orders", "adders"))
    rate = F.try_divide(buyers.cast("double"), users)
    spread = F.try_divide(F.lit(1.0), F.col("control_adders")) + F.try_divide(
        F.lit(1.0), F.col("treatment_adders")
    )
    one = F.coalesce(
        always_valid_p(F.col("effect_abs"), rate * (1.0 - rate) * spread, tau), F.lit(1.0)
    )
    until = Window.partitionBy(*by).orderBy("look")
    return tested.withColumn("_one", one).withColumn("always_valid_p", F.min("_one").over(until)).drop("_one")


def _of_look(boundaries: Sequence[float]) -> Column:
    """The boundary of a row's look; none beyond the plan."""
    return F.get(F.array(*[F.lit(float(b)) for b in boundaries]), F.col("look") - 1)


def interim_looks(
    events: EventTables,
    looks: int = LOOKS,
    alpha: float = 0.05,
    tau: float = TAU,
    planned_users: int | None = None,
) -> DataFrame:
    """One row per day: the test of all traffic so far against three stopping rules.

    ``boundary_<rule>`` is the critical value of |z|, ``stop_<rule>`` whether the look crosses
    it, ``stopped_<rule>`` whether this or an earlier look did. Boundaries belong to ``looks``
    equal steps; with ``planned_users`` to the users really seen at each look, which reads
    one number per day to the driver. The always-valid p-value needs no plan.
    """
    totals = running_totals(new_per_day(first_days(events), ["variant"]), [])
    information = equal_looks(looks)
    if planned_users:
        seen = totals.select("look", (F.col("control_adders") + F.col("treatment_adders")).alias("users"))
        information = [r["users"] / planned_users for r in seen.orderBy("look").collect()]
    tested = tested_looks(totals, [], alpha, tau)
    until = Window.orderBy("look")
    columns = [
        "date", "look", "control_adders", "control_orders", "treatment_adders", "treatment_orders",
        "effect_abs", "z", "p_value", "always_valid_p",
    ]
    stops: dict[str, Column] = {"always_valid": F.col("always_valid_p") <= alpha}
    for rule in SPENDING:
        boundary = _of_look(spending_boundaries(information, alpha, rule))
        tested = tested.withColumn(f"boundary_{rule}", boundary)
        columns.append(f"boundary_{rule}")
        stops[rule] = F.abs("z") >= F.col(f"boundary_{rule}")
    for rule, crosses in stops.items():
        crosses = F.coalesce(crosses, F.lit(False))
        tested = tested.withColumns(
            {f"stop_{rule}": crosses, f"stopped_{rule}": F.max(crosses).over(until)}
        )
        columns += [f"stop_{rule}", f"stopped_{rule}"]
    return tested.select(*columns)


def early_stopping_errors(
    events: EventTables,
    repeats: int = 100,
    looks: int = LOOKS,
    alpha: float = 0.05,
    tau: float = TAU,
    salt: str = "looks",
) -> DataFrame:
    """How often each rule stops an experiment without an effect, over all its looks.

    Every replicate deals the real users anew, with all their days, so its arms differ by
    chance alone. ``every_look`` is the plain test at each look, which errs far too often.
    """
    slots = int(events.add_to_cart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    users = first_days(events, []).repartition(slots, "user_id")
    dealt = users.withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    ).withColumn(
        "variant",
        variant_of_digest(salted_digest(F.col("user_id"), F.concat(F.lit(salt), F.col("replicate")))),
    )
    totals = running_totals(new_per_day(dealt, ["replicate", "variant"]), ["replicate"])
    tested = tested_looks(totals, ["replicate"], alpha, tau).where(F.col("look") <= looks)
    rules = {"every_look": F.col("p_value") < alpha, "always_valid": F.col("always_valid_p") <= alpha}
    for rule in SPENDING:
        rules[rule] = F.abs("z") >= _of_look(spending_boundaries(equal_looks(looks), alpha, rule))
    ever = tested.groupBy("replicate").agg(
        F.max("look").alias("looks"),
        *[F.coalesce(F.max(crosses), F.lit(False)).alias(rule) for rule, crosses in rules.items()],
    )
    counts = ever.agg(
        F.max("looks").alias("looks"), *[F.count_if(F.col(rule)).alias(rule) for rule in rules]
    )
    rows = F.array(
        *[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("false_stops")) for rule in rules]
    )
    return counts.select(F.col("looks").cast("bigint").alias("looks"), F.inline(rows)).select(
        "rule",
        F.lit(repeats).cast("bigint").alias("repeats"),
        "looks",
        "false_stops",
        (F.col("false_stops") / F.lit(float(repeats))).alias("false_positive_rate"),
    )
