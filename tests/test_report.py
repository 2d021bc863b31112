"""The quality report: one pass for three checks, and faults that stay in their row."""

from __future__ import annotations

import pytest
from frames import begin, cart, order, records, tables, view
from pyspark.sql import functions as F

from splitlane.operators import quality

SHARED = (quality.ORDERS_CHECK, quality.STEPS_CHECK, quality.TIME_CHECK)


def at(minute):
    return f"2025-01-01T10:{minute:02d}:00Z"


@pytest.fixture(scope="module")
def broken(spark):
    """Orphans with and without a key, several per key, and steps before their begin."""
    return tables(
        spark,
        add_to_cart=[cart("u", at(0)), cart("v", at(0), "treatment")],
        begin_checkout=[begin("u", "c1", at(5)), begin("u", "c2", at(1)), begin("v", "c3", at(9)), begin("w", None, at(1))],
        checkout_step_view=[
            view("c1", "address", 0, at(4), 10),
            view("c2", "address", 0, at(2), 10),
            view("c3", "address", 0, None, 10),
            *[view("lost", "address", 0, at(i), 10) for i in range(3)],
            view(None, "review", 3, at(2), 10),
            *[view(f"z{i}", "review", 3, at(2), 10) for i in range(4)],
        ],
        order_completed=[
            order("9", "c1", "u", at(8)),
            *[order(str(i), "gone", "u", at(8)) for i in (4, 2, 7)],
            order("5", None, "u", at(8)),
            *[order(f"late{i}", f"x{i}", "u", at(8)) for i in range(5)],
        ],
    )


def test_the_shared_pass_says_what_the_single_checks_say(spark, broken):
    fine = tables(
        spark,
        begin_checkout=[begin("u", "c1", at(5))],
        checkout_step_view=[view("c1", "address", 0, at(6), 10)],
        order_completed=[order("9", "c1", "u", at(8))],
    )
    for events in (broken, fine, tables(spark)):
        shared = quality._checkout_verdicts(events)
        assert set(shared) == set(SHARED)
        for name, build in quality.CHECKS:
            if name in SHARED:
                assert [shared[name]] == records(build(events)), name


def test_a_checkout_begun_twice_counts_once(spark):
    events = tables(
        spark,
        begin_checkout=[begin("u", "c1", at(1)), begin("u", "c1", at(8)), begin("u", "c1", at(9))],
        checkout_step_view=[view("c1", "address", 0, at(5), 10)],
    )
    assert quality._checkout_verdicts(events)[quality.TIME_CHECK]["message"] == "1 checkouts start before they begin; sample: c1"


def test_a_fault_at_run_time_stays_in_the_checks_that_meet_it(spark, broken):
    sound = {r["name"]: r for r in records(quality.report(broken, aa_mode=True))}
    bad = F.when(F.col("order_id").isNotNull(), F.raise_error(F.lit("broken file"))).otherwise(F.col("checkout_id"))
    parts = dict(broken.items())
    parts["order_completed"] = parts["order_completed"].withColumn("checkout_id", bad.cast("string"))
    events = type(broken)(**parts)
    rows = {r["name"]: r for r in records(quality.report(events, aa_mode=True))}
    assert set(rows) == set(sound)
    assert not rows[quality.ORDERS_CHECK]["passed"] and rows[quality.ORDERS_CHECK]["message"].startswith("error: ")
    for name in set(rows) - {quality.ORDERS_CHECK}:
        assert rows[name] == sound[name]
