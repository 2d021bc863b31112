"""Power and false-positive rates from re-randomized real traffic.

Each replicate deals the real users to two arms by a salted hash, keeps a hash-chosen
part of them for a smaller sample size, and turns some treatment non-buyers into buyers
for a given uplift. A user is dealt, kept and lifted with all their days at once, as in
the experiment itself. One digest per (user, replicate) decides all three, and one
aggregation reduces a replicate to counts for every sample size and uplift at once: the
shuffle carries a few rows per replicate, whatever the traffic.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.functions.assignment import (
    draw,
    draw_threshold,
    salted_digest,
    variant_of_digest,
)
from splitlane.functions.inference import two_proportion_test
from splitlane.operators.metrics import user_days
from splitlane.sources.contract import EventTables

# Digest slots; slot 3 stays unused because its last digit decides the variant.
SAMPLE_SLOT, FLIP_SLOT = 0, 1


@dataclass(frozen=True)
class PowerGrid:
    """Sample sizes, multiplicative uplifts and repeats.

    Without ``users_per_day`` the sizes are ``sample_pcts`` of all users, tested over
    the whole window. With it, sizes are numbers of users tested on one day, ``day`` or
    else the first; users are re-used under new digests where the day has too few.
    """

    sample_pcts: tuple[int, ...] = (25, 50, 100)
    uplifts: tuple[float, ...] = (0.0, 0.01, 0.02, 0.03)
    repeats: int = 20
    salt: str = "replicate"
    alpha: float = 0.05
    users_per_day: tuple[int, ...] = ()
    day: dt.date | None = None

    @property
    def sizes(self) -> tuple[int, ...]:
        return self.users_per_day or self.sample_pcts


GRID = PowerGrid()


def known_user_days(events: EventTables) -> DataFrame:
    """The user-days that can be dealt: rows without a user belong to nobody."""
    return user_days(events).where(F.col("user_id").isNotNull())


def grid_user_days(events: EventTables, grid: PowerGrid) -> DataFrame:
    units = known_user_days(events)
    if not grid.users_per_day:
        return units
    first = events.add_to_cart.agg(F.min("date")).scalar()
    return units.where(F.col("date") == (F.lit(grid.day) if grid.day else first))


def with_digests(
    units: DataFrame,
    keep: list[str],
    repeats: int,
    salt: str,
    copies: Column | None = None,
) -> DataFrame:
    """Every user's totals once per replicate, with the digest that decides their fate.

    ``days`` counts a user's user-days and ``orders`` the converted ones, per value of
    ``keep``. The work per user grows by the number of replicates, so users are first
    spread over all shuffle partitions: adaptive execution sizes partitions by their
    bytes before this step and would leave the hashing to too few tasks. Totals need
    no further shuffle. ``copies`` repeats users as independent ones.
    """
    slots = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    users = (
        units.repartition(slots, "user_id")
        .groupBy("user_id", *keep)
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.count_if(F.col("converted")).alias("orders"),
        )
    )
    unit = F.col("user_id")
    if copies is not None:
        users = users.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
        unit = F.when(F.col("_copy") == 1, unit).otherwise(
            F.concat(unit, F.lit("#"), F.col("_copy"))
        )
    return users.withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    ).withColumn("digest", salted_digest(unit, F.concat(F.lit(salt), F.col("replicate"))))


def traffic_facts(units: DataFrame, grid: PowerGrid) -> Column:
    """One scalar struct: a draw threshold per size and uplift, and the traffic.

    Lifting a base rate p to p(1 + u) converts p * u / (1 - p) of the non-buyers.
    As one subquery it runs once, and no row computes a threshold itself.
    """
    p, users = F.col("_rate"), F.col("users")
    facts = units.agg(
        F.avg(F.col("converted").cast("double")).alias("_rate"),
        F.count_distinct("user_id").alias("users"),
        F.try_divide(F.count(F.lit(1)).cast("double"), F.count_distinct("date")).alias(
            "per_day"
        ),
    )
    if grid.users_per_day:
        shares = [F.try_divide(F.lit(float(n)), users) for n in grid.users_per_day]
    else:
        shares = [F.lit(pct / 100.0) for pct in grid.sample_pcts]
    copies = F.greatest(F.lit(1.0), *shares, F.lit(1.0))
    facts = facts.withColumn("copies", F.ceil(copies).cast("int"))
    cuts = [
        draw_threshold(F.coalesce(share / F.col("copies"), F.lit(0.0))).alias(f"s{i}")
        for i, share in enumerate(shares)
    ] + [
        draw_threshold(F.coalesce(F.try_divide(p * u, 1.0 - p), F.lit(0.0))).alias(f"u{j}")
        for j, u in enumerate(grid.uplifts)
    ]
    return facts.select(F.struct(*cuts, "copies", "users", "per_day")).scalar()


def replicate_counts(units: DataFrame, facts: Column, grid: PowerGrid) -> DataFrame:
    """Adders and orders per replicate, arm, sample size and uplift."""
    sampled = {
        f"in_{i}": draw(F.col("digest"), SAMPLE_SLOT) < facts.getField(f"s{i}")
        for i in range(len(grid.sizes))
    }
    flipped = {
        f"flip_{j}": (F.col("variant") == "treatment")
        & (draw(F.col("digest"), FLIP_SLOT) < facts.getField(f"u{j}"))
        for j in range(len(grid.uplifts))
    }
    points = [
        (i, size, j, uplift)
        for i, size in enumerate(grid.sizes)
        for j, uplift in enumerate(grid.uplifts)
    ]
    adders = [f"sum(if(in_{i}, days, 0)) AS n_{i}" for i in range(len(grid.sizes))]
    orders = [
        f"sum(if(in_{i}, if(flip_{j}, days, orders), 0)) AS hit_{i}_{j}"
        for i, _, j, _ in points
    ]
    cells = ", ".join(
        f"struct({size} AS size, {uplift!r}D AS uplift, n_{i} AS adders,"
        f" hit_{i}_{j} AS orders)"
        for i, size, j, uplift in points
    )
    dealt = with_digests(
        units, [], grid.repeats, grid.salt, facts.getField("copies")
    ).withColumn("variant", variant_of_digest(F.col("digest")))
    return (
        dealt.withColumns({**sampled, **flipped})
        .groupBy("replicate", "variant")
        .agg(*map(F.expr, adders + orders))
        .selectExpr("replicate", "variant", f"inline(array({cells}))")
    )


def _arms(cells: DataFrame, keys: list[str]) -> DataFrame:
    def pick(variant: str, measure: str) -> Column:
        chosen = F.when(F.col("variant") == variant, F.col(measure))
        return F.max(chosen).alias(f"{variant}_{measure}")

    return cells.groupBy(*keys).agg(
        *[pick(v, m) for v in ("control", "treatment") for m in ("adders", "orders")]
    )


def detection_grid(events: EventTables, grid: PowerGrid = GRID) -> DataFrame:
    """Share of replicates detecting each uplift at each sample size.

    ``users_tested`` is the number of users in a replicate, both arms together;
    ``users_per_day`` the traffic that goes with it. A replicate that cannot be tested
    counts as not detecting: the denominator is always the number of repeats.
    """
    units = grid_user_days(events, grid)
    facts = traffic_facts(units, grid)
    arms = _arms(replicate_counts(units, facts, grid), ["replicate", "size", "uplift"])
    tested = two_proportion_test(
        arms,
        "control_orders",
        "control_adders",
        "treatment_orders",
        "treatment_adders",
        grid.alpha,
    )
    detected = F.coalesce(F.col("p_value") < grid.alpha, F.lit(False))

    def sized(traffic: str) -> Column:
        if grid.users_per_day:
            return F.col("size").cast("bigint")
        return F.floor(facts.getField(traffic) * F.col("size") / 100.0).cast("bigint")

    return (
        tested.groupBy("size", "uplift")
        .agg(F.count_if(detected).alias("detections"))
        .select(
            sized("per_day").alias("users_per_day"),
            sized("users").alias("users_tested"),
            "uplift",
            F.lit(grid.repeats).cast("bigint").alias("repeats"),
            "detections",
            (F.col("detections") / F.lit(float(grid.repeats))).alias("detection_rate"),
            F.lit(grid.alpha).alias("alpha"),
        )
    )


def grid_points(events: EventTables, grid: PowerGrid = GRID) -> DataFrame:
    """Every run of the grid with the user-days its re-randomization gives each arm."""
    units = grid_user_days(events, grid)
    facts = traffic_facts(units, grid)
    arms = _arms(replicate_counts(units, facts, grid), ["replicate", "size", "uplift"])
    return arms.select(
        F.col("size").alias("users_per_day" if grid.users_per_day else "sample_pct"),
        "uplift",
        "replicate",
        F.concat(F.lit(grid.salt), F.col("replicate")).alias("salt"),
        F.coalesce("control_adders", F.lit(0)).alias("control_adders"),
        F.coalesce("treatment_adders", F.lit(0)).alias("treatment_adders"),
    )
