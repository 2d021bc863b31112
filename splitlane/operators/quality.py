"""Data-quality checks: integrity, enums, order of events, randomization."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlane.functions.formatting import settled
from splitlane.functions.inference import two_proportion_test
from splitlane.operators import marts
from splitlane.operators.metrics import (
    Day,
    conversions,
    share_of_total,
    user_days,
)
from splitlane.sources.contract import CONTRACT_ENUMS, GATE_ENUMS, VARIANTS, EventTables

BALANCE_BAND = (48.0, 52.0)
SAMPLE_ROWS = 10
SAMPLE_SHOWN = 5
SHOWN_CHARS = 20


# --- referential integrity -------------------------------------------------------


def _key_presence(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Per key: how many rows carry it and whether a parent has it.

    Both tables meet in one aggregation, so rows combine per key before the shuffle
    and a key owning a large share of them weighs no more than any other. A missing
    key has no parent.
    """
    known = F.col(key).isNotNull()
    return (
        rows.select(key, F.lit(1).alias("_row"), F.lit(False).alias("_parent"))
        .unionAll(parents.select(key, F.lit(0), known))
        .groupBy(key)
        .agg(F.sum("_row").alias("rows"), F.max("_parent").alias("has_parent"))
    )


def _integrity(presence: DataFrame) -> DataFrame:
    orphaned = F.when(F.col("has_parent"), 0).otherwise(F.col("rows"))
    return presence.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(orphaned), F.lit(0)).alias("orphans"),
    ).withColumn("passed", F.col("orphans") == 0)


def _order_presence(events: EventTables) -> DataFrame:
    return _key_presence(events.order_completed, events.begin_checkout, "checkout_id")


def _step_presence(events: EventTables) -> DataFrame:
    return _key_presence(
        events.checkout_step_view, events.begin_checkout, "checkout_id"
    )


def orphan_orders(events: EventTables) -> DataFrame:
    """Orders whose checkout was never begun: total, orphans, verdict."""
    return _integrity(_order_presence(events))


def orphan_steps(events: EventTables) -> DataFrame:
    """Step views whose checkout was never begun: total, orphans, verdict."""
    return _integrity(_step_presence(events))


def _first_orphans(
    rows: DataFrame, presence: DataFrame, key: str, detail: str, limit: int
) -> DataFrame:
    """The first ``limit`` orphaned rows by (key, detail); a missing key sorts first.

    They all lie in the first ``limit`` orphaned keys, so only those few are broadcast.
    """
    orphaned = presence.where(~F.col("has_parent") & (F.col("rows") > 0))
    wanted = orphaned.select(F.col(key).alias("_wanted")).orderBy("_wanted").limit(limit)
    same = F.col(key).eqNullSafe(F.col("_wanted"))
    return (
        rows.join(F.broadcast(wanted), same, "left_semi")
        .select(F.col(key).alias("key"), F.col(detail).alias("detail"))
        .orderBy("key", "detail")
        .limit(limit)
    )


def orphan_order_sample(
    events: EventTables, limit: int = SAMPLE_ROWS, presence: DataFrame | None = None
) -> DataFrame:
    presence = _order_presence(events) if presence is None else presence
    return _first_orphans(
        events.order_completed, presence, "checkout_id", "order_id", limit
    )


def orphan_step_sample(
    events: EventTables, limit: int = SAMPLE_ROWS, presence: DataFrame | None = None
) -> DataFrame:
    presence = _step_presence(events) if presence is None else presence
    return _first_orphans(
        events.checkout_step_view, presence, "checkout_id", "step_name", limit
    )


# --- order of events -------------------------------------------------------------


def early_steps(events: EventTables) -> DataFrame:
    """Begun checkouts whose first step view precedes the begin event."""
    first = events.checkout_step_view.groupBy("checkout_id").agg(
        F.min("timestamp").alias("first_step_ts")
    )
    begun = events.begin_checkout.select(
        "checkout_id", "user_id", F.col("timestamp").alias("begin_ts")
    )
    return begun.join(first, "checkout_id").where(F.col("first_step_ts") < F.col("begin_ts"))


def timestamp_order(events: EventTables, early: DataFrame | None = None) -> DataFrame:
    """Checkouts with step views, order violations, verdict."""
    early = early_steps(events) if early is None else early
    violations = early.agg(F.count(F.lit(1))).scalar()
    return (
        events.checkout_step_view.agg(F.count_distinct("checkout_id").alias("checkouts"))
        .withColumn("violations", violations)
        .withColumn("passed", F.col("violations") == 0)
    )


def early_step_sample(
    events: EventTables, limit: int = SAMPLE_ROWS, early: DataFrame | None = None
) -> DataFrame:
    early = early_steps(events) if early is None else early
    return (
        early.select(
            F.col("checkout_id").alias("key"),
            F.col("begin_ts").cast("string").alias("detail"),
        )
        .orderBy("key", "detail")
        .limit(limit)
    )


def violation_samples(events: EventTables, limit: int = SAMPLE_ROWS) -> DataFrame:
    """A short, repeatable list of offending keys per check."""
    samples = {
        "orphan_orders": orphan_order_sample(events, limit),
        "orphan_steps": orphan_step_sample(events, limit),
        "timestamp_order": early_step_sample(events, limit),
    }
    out = None
    for name, df in samples.items():
        df = df.select(
            F.lit(name).alias("check"),
            F.substring("key", 1, SHOWN_CHARS).alias("key"),
            F.col("detail").cast("string").alias("detail"),
        )
        out = df if out is None else out.unionByName(df)
    return out


# --- enums -----------------------------------------------------------------------


def enum_profile(
    events: EventTables,
    contract: Mapping[tuple[str, str], tuple[str, ...]] = GATE_ENUMS,
) -> DataFrame:
    """Rows per value of every contracted enum column, and whether the value is allowed.

    All columns of a table are counted in one pass. A missing value is not allowed.
    """
    by_table: dict[str, dict[str, tuple[str, ...]]] = {}
    for (table, field), allowed in contract.items():
        by_table.setdefault(table, {})[field] = allowed
    out = None
    for table, fields in by_table.items():
        pairs = F.array(
            *[
                F.struct(
                    F.lit(field).alias("field"),
                    F.col(field).alias("value"),
                    allowed_value(F.col(field), allowed).alias("valid"),
                )
                for field, allowed in fields.items()
            ]
        )
        part = (
            events[table]
            .select(F.inline(pairs))
            .groupBy("field", "value", "valid")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table).alias("table_name"), "field", "value", "valid", "rows")
        )
        out = part if out is None else out.unionByName(part)
    return out


def allowed_value(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def enum_violations(
    events: EventTables,
    contract: Mapping[tuple[str, str], tuple[str, ...]] = GATE_ENUMS,
) -> DataFrame:
    return enum_profile(events, contract).where(~F.col("valid")).drop("valid")


def enum_summary(
    events: EventTables,
    contract: Mapping[tuple[str, str], tuple[str, ...]] = CONTRACT_ENUMS,
) -> DataFrame:
    """Per contracted column: distinct values, and the values and rows that break it.

    A column of an empty table has no row.
    """
    bad = ~F.col("valid")
    return (
        enum_profile(events, contract)
        .groupBy("table_name", "field")
        .agg(
            F.count(F.lit(1)).alias("distinct_values"),
            F.count_if(bad).alias("bad_values"),
            F.sum(F.when(bad, F.col("rows")).otherwise(0)).alias("bad_rows"),
        )
        .withColumn("passed", F.col("bad_values") == 0)
    )


def required_fields(events: EventTables) -> DataFrame:
    """Per table and field: rows, and rows without a value.

    Every field of the contract is required. An unreadable timestamp is a missing one.
    """
    out = None
    for table, df in events.items():
        counts = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(field).alias(f"_{field}") for field in df.columns],
        )
        fields = F.array(
            *[
                F.struct(
                    F.lit(field).alias("field"),
                    (F.col("rows") - F.col(f"_{field}")).alias("missing"),
                )
                for field in df.columns
            ]
        )
        part = counts.select(F.lit(table).alias("table_name"), "rows", F.inline(fields))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("passed", F.col("missing") == 0)


def with_contract_flag(
    df: DataFrame,
    contract: Mapping[str, tuple[str, ...]],
    required: Iterable[str] = (),
) -> DataFrame:
    """Row-level contract: the first broken field, and ``valid`` when none is.

    Enum fields come first, then ``required`` ones without a value.
    """
    broken = F.lit(None).cast("string")
    for field in reversed([f for f in required if f not in contract]):
        broken = F.when(F.col(field).isNull(), F.lit(field)).otherwise(broken)
    for field, allowed in reversed(list(contract.items())):
        bad = ~allowed_value(F.col(field), allowed)
        broken = F.when(bad, F.lit(field)).otherwise(broken)
    return df.withColumn("broken_field", broken).withColumn(
        "valid", F.col("broken_field").isNull()
    )


def quarantine(
    df: DataFrame,
    contract: Mapping[str, tuple[str, ...]],
    required: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Split a table into rows that keep the contract and rows that break it."""
    flagged = with_contract_flag(df, contract, required)
    return (
        flagged.where("valid").drop("valid", "broken_field"),
        flagged.where("NOT valid").drop("valid"),
    )


def contract_outcomes(events: EventTables) -> DataFrame:
    """Rows of every table by the contract field they break first, ``none`` if none."""
    out = None
    for table, df in events.items():
        enums = {f: allowed for (t, f), allowed in CONTRACT_ENUMS.items() if t == table}
        part = (
            with_contract_flag(df, enums, df.columns)
            .groupBy("date", F.coalesce("broken_field", F.lit("none")).alias("broken_field"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table).alias("table_name"), "date", "broken_field", "rows")
        )
        out = part if out is None else out.unionByName(part)
    return out


# --- randomization ---------------------------------------------------------------


def variant_balance(events: EventTables) -> DataFrame:
    """Users and share per variant, and whether the treatment share is in its band."""
    users = (
        marts.experiments(events).groupBy("variant").agg(F.count(F.lit(1)).alias("users"))
    )
    shares = share_of_total(users, "users", "percentage", 2)
    treated = F.when(
        F.col("variant") == "treatment", F.col("percentage").between(*BALANCE_BAND)
    )
    verdict = F.max(treated).over(Window.partitionBy())
    return shares.withColumn("in_band", F.coalesce(verdict, F.lit(False)))


def side_by_side(
    cells: DataFrame, keys: list[str], measures: list[str]
) -> DataFrame:
    """Control and treatment rows of a cell table as columns of one row per key."""
    picks = [
        F.max(F.when(F.col("variant") == variant, F.col(measure))).alias(
            f"{variant}_{measure}"
        )
        for variant in VARIANTS
        for measure in measures
    ]
    return cells.groupBy(*keys).agg(*picks)


def aa_counts(events: EventTables, day: Day = None) -> DataFrame:
    """Same-day adders and the orderers among them, per variant of one day."""
    units = user_days(events, day, all_days=False)
    return conversions(units, ["date", "variant"]).select(
        "variant", "adders", F.col("orders").alias("orderers"), "date"
    )


def aa_test(events: EventTables, day: Day = None, alpha: float = 0.05) -> DataFrame:
    """A/A check: passes when the two variants do not differ significantly."""
    wide = side_by_side(aa_counts(events, day), ["date"], ["adders", "orderers"])
    tested = two_proportion_test(
        wide,
        "control_orderers",
        "control_adders",
        "treatment_orderers",
        "treatment_adders",
        alpha,
    )
    return tested.withColumn(
        "passed", F.coalesce(F.col("p_value") >= alpha, F.lit(False))
    )


# --- the gate --------------------------------------------------------------------


def _verdict(name: str, df: DataFrame, passed: Column, message: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("name"), passed.alias("passed"), message.alias("message")
    )


def _shown(sample: DataFrame, column: str) -> Column:
    """The first few sampled ids as one text; the sample is at most ten rows."""
    ids = sample.limit(SAMPLE_SHOWN).agg(F.array_sort(F.collect_list(column)))
    return F.array_join(ids.scalar(), ", ")


def _orphan_verdict(
    name: str, counts: DataFrame, noun: str, sample: DataFrame, shown: str
) -> DataFrame:
    good = F.concat(F.lit("all "), F.col("total"), F.lit(f" {noun} have a checkout"))
    bad = F.concat(
        F.col("orphans"), F.lit(f" orphaned {noun}; sample: "), _shown(sample, shown)
    )
    return _verdict(
        name, counts, F.col("passed"), F.when(F.col("passed"), good).otherwise(bad)
    )


def _orders_verdict(events: EventTables) -> DataFrame:
    presence = _order_presence(events)
    return _orphan_verdict(
        "orders reference checkouts",
        _integrity(presence),
        "orders",
        orphan_order_sample(events, presence=presence),
        "detail",
    )


def _steps_verdict(events: EventTables) -> DataFrame:
    presence = _step_presence(events)
    return _orphan_verdict(
        "steps reference checkouts",
        _integrity(presence),
        "step views",
        orphan_step_sample(events, presence=presence),
        "key",
    )


def _enum_verdict(events: EventTables) -> DataFrame:
    bad = enum_violations(events).agg(
        F.count(F.lit(1)).alias("_values"), F.sum("rows").alias("_rows")
    )
    passed = F.col("_values") == 0
    message = F.when(passed, "all enum values are allowed").otherwise(
        F.concat(F.col("_values"), F.lit(" invalid values in "), F.col("_rows"), F.lit(" rows"))
    )
    return _verdict("enum values", bad, passed, message)


def _balance_verdict(events: EventTables) -> DataFrame:
    share = variant_balance(events).agg(
        F.max(F.when(F.col("variant") == "treatment", F.col("percentage"))).alias("_pct")
    )
    passed = F.coalesce(F.col("_pct").between(*BALANCE_BAND), F.lit(False))
    message = F.when(F.col("_pct").isNull(), "no treatment users").otherwise(
        F.format_string("treatment share %.2f%% (band 48-52%%)", F.col("_pct"))
    )
    return _verdict("randomization balance", share, passed, message)


def _order_verdict(events: EventTables) -> DataFrame:
    early = early_steps(events)
    good = F.concat(F.lit("all "), F.col("checkouts"), F.lit(" checkouts are in order"))
    bad = F.concat(
        F.col("violations"),
        F.lit(" checkouts start before they begin; sample: "),
        _shown(early_step_sample(events, early=early), "key"),
    )
    return _verdict(
        "timestamp order",
        timestamp_order(events, early),
        F.col("passed"),
        F.when(F.col("passed"), good).otherwise(bad),
    )


def _aa_verdict(events: EventTables) -> DataFrame:
    test = aa_test(events)
    detail = F.format_string(
        "control %d/%d, treatment %d/%d, p=%.4f",
        "control_orderers",
        "control_adders",
        "treatment_orderers",
        "treatment_adders",
        settled(F.col("p_value"), 4),
    )
    message = F.when(F.col("invalid_reason").isNull(), detail).otherwise(
        F.col("invalid_reason")
    )
    # A day without carts gives no row; the check must still report.
    return _verdict(
        "A/A difference",
        test.agg(
            F.coalesce(F.max("passed"), F.lit(False)).alias("passed"),
            F.coalesce(F.max(message), F.lit("no carts")).alias("_message"),
        ),
        F.col("passed"),
        F.col("_message"),
    )


ORDERS_CHECK, STEPS_CHECK, TIME_CHECK = (
    "orders reference checkouts",
    "steps reference checkouts",
    "timestamp order",
)
CHECKS: tuple[tuple[str, Callable[[EventTables], DataFrame]], ...] = (
    (ORDERS_CHECK, _orders_verdict),
    (STEPS_CHECK, _steps_verdict),
    ("enum values", _enum_verdict),
    ("randomization balance", _balance_verdict),
    (TIME_CHECK, _order_verdict),
)


def _checks(aa_mode: bool):
    return CHECKS + ((("A/A difference", _aa_verdict),) if aa_mode else ())


def _fault_text(fault: Exception) -> str:
    condition = fault.getCondition() if isinstance(fault, PySparkException) else None
    return f"error: {condition or type(fault).__name__}"


def _checkout_verdicts(events: EventTables) -> dict[str, dict]:
    """The three checks by checkout from one pass over begins, orders and step views.

    The tables meet in one union and one aggregation by checkout, which is kept for the few
    lookups of a failed check: its first keys come from a bounded sort, and only order ids
    need their table again. A checkout begun several times is out of order if any of its
    begins follows its first step, and counts once.
    """
    key, none = F.col("checkout_id"), F.lit(None).cast("timestamp_ntz")
    touches = (
        events.begin_checkout.select(
            key, F.lit(0).alias("_order"), F.lit(0).alias("_step"), key.isNotNull().alias("_begun"),
            F.col("timestamp").cast("timestamp_ntz").alias("_begin_at"), none.alias("_step_at"),
        )
        .unionAll(events.order_completed.select(key, F.lit(1), F.lit(0), F.lit(False), none, none))
        .unionAll(
            events.checkout_step_view.select(
                key, F.lit(0), F.lit(1), F.lit(False), none, F.col("timestamp").cast("timestamp_ntz")
            )
        )
    )
    per = (
        touches.groupBy("checkout_id")
        .agg(
            F.sum("_order").alias("orders"),
            F.sum("_step").alias("steps"),
            F.max("_begun").alias("begun"),
            F.max("_begin_at").alias("begin_at"),
            F.min("_step_at").alias("step_at"),
        )
        .withColumn("early", key.isNotNull() & F.coalesce(F.col("step_at") < F.col("begin_at"), F.lit(False)))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )

    def total(count: str, which: Column | None = None) -> Column:
        counted = F.col(count) if which is None else F.when(which, F.col(count))
        return F.coalesce(F.sum(counted), F.lit(0))

    def first_keys(which: Column) -> list:
        return per.where(which).select("checkout_id", "steps").orderBy("checkout_id").limit(SAMPLE_SHOWN).collect()

    try:
        orphan = ~F.col("begun")
        row = per.agg(
            total("orders").alias("orders"),
            total("orders", orphan).alias("lost_orders"),
            total("steps").alias("steps"),
            total("steps", orphan).alias("lost_steps"),
            F.count_if((F.col("steps") > 0) & key.isNotNull()).alias("checkouts"),
            F.count_if("early").alias("violations"),
        ).head()
        found = {}
        if row["lost_orders"]:
            keys = [r["checkout_id"] for r in first_keys(orphan & (F.col("orders") > 0))]
            wanted = key.isin([k for k in keys if k is not None])
            ids = (
                events.order_completed.where(wanted | key.isNull() if None in keys else wanted)
                .select("checkout_id", "order_id")
                .orderBy("checkout_id", "order_id")
                .limit(SAMPLE_SHOWN)
            )
            found["orders"] = [r["order_id"] for r in ids.collect()]
        if row["lost_steps"]:
            keys = first_keys(orphan & (F.col("steps") > 0))
            found["steps"] = [r["checkout_id"] for r in keys for _ in range(min(r["steps"], SAMPLE_SHOWN))][:SAMPLE_SHOWN]
        if row["violations"]:
            found["early"] = [r["checkout_id"] for r in first_keys(F.col("early"))]
    finally:
        per.unpersist()

    def sample(name: str) -> str:
        return ", ".join(sorted(x for x in found[name] if x is not None))

    def verdict(name: str, bad: int, good_text: str, bad_text: str, shown: str) -> dict:
        message = good_text if not bad else f"{bad} {bad_text}; sample: {sample(shown)}"
        return {"name": name, "passed": not bad, "message": message}

    rows = [
        verdict(
            ORDERS_CHECK, row["lost_orders"], f"all {row['orders']} orders have a checkout", "orphaned orders", "orders"
        ),
        verdict(
            STEPS_CHECK, row["lost_steps"], f"all {row['steps']} step views have a checkout", "orphaned step views", "steps"
        ),
        verdict(
            TIME_CHECK,
            row["violations"],
            f"all {row['checkouts']} checkouts are in order",
            "checkouts start before they begin",
            "early",
        ),
    ]
    return {r["name"]: r for r in rows}


def run_checks(events: EventTables, aa_mode: bool = False) -> list[dict]:
    """Run the checks and return their verdicts, for gating a run.

    Checks that read the same tables share one pass; the rest run beside it, as Spark jobs of
    a few threads. Whatever goes wrong in a check, unreadable files included, becomes its
    failed verdict and leaves the others alone: if the shared pass fails, its checks run one
    by one. Each brings a few rows to the driver.
    """

    def alone(name: str, build: Callable[[EventTables], DataFrame]) -> list[dict]:
        try:
            return [row.asDict() for row in build(events).collect()]
        except Exception as fault:  # noqa: BLE001  any failure is a verdict here
            return [{"name": name, "passed": False, "message": _fault_text(fault)}]

    def shared() -> dict[str, dict]:
        try:
            return _checkout_verdicts(events)
        except Exception:  # noqa: BLE001  the checks themselves say which table is at fault
            return {}

    checks = _checks(aa_mode)
    started = inheritable_thread_target(events.add_to_cart.sparkSession)
    with ThreadPoolExecutor(len(checks)) as pool:
        together = pool.submit(started(shared))
        apart = {
            name: pool.submit(started(alone), name, build)
            for name, build in checks
            if name not in (ORDERS_CHECK, STEPS_CHECK, TIME_CHECK)
        }
        known = together.result()
        verdicts = []
        for name, build in checks:
            if name in apart:
                verdicts += apart[name].result()
            else:
                verdicts += [known[name]] if name in known else alone(name, build)
    return verdicts


def report(events: EventTables, aa_mode: bool = False) -> DataFrame:
    """``run_checks`` as a table: one row per check with name, passed and message.

    The checks run when the table is asked for, so that a fault at run time is a failed row.
    """
    rows = [
        F.struct(*[F.lit(v[c]).alias(c) for c in ("name", "passed", "message")]) for v in run_checks(events, aa_mode)
    ]
    return events.add_to_cart.sparkSession.range(1).select(F.inline(F.array(*rows)))
