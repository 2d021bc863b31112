"""Excluded traffic leaves every table; errors against abandonment."""

from __future__ import annotations

import math

import pytest
from frames import begin, cart, error, order, payment, records, tables, view
from pyspark.sql import functions as F

from splitlane.operators import exclusions


def at(minute):
    return f"2025-01-01T10:{minute:02d}:00Z"


@pytest.fixture(scope="module")
def events(spark):
    rows = {
        "add_to_cart": [cart("bot", at(i)) for i in range(5)] + [cart("ann", at(1)), cart("staff-1", at(2)), cart(None, at(3))],
        "begin_checkout": [begin("bot", "cb", at(5)), begin("ann", "ca", at(5)), begin("staff-1", "cs", at(5)), begin(None, "cn", at(5))],
        "checkout_step_view": [view(c, "address", 0, at(6), 1) for c in ("cb", "ca", "cs", "cn", None, "cx")],
        "form_error": [error(c, "payment", at(6)) for c in ("cb", "ca", None)],
        "payment_attempt": [payment(c, True, at(7)) for c in ("cb", "ca", "cs", "only-order")],
        "order_completed": [order("1", "cb", "bot", at(8)), order("2", "ca", "ann", at(8)), order("3", "only-order", "staff-1", at(8)), order("4", None, None, at(8))],
    }
    return tables(spark, **rows)


def test_excluded_users_leave_all_six_tables(spark, events):
    excluded = exclusions.excluded_users(
        [exclusions.fast_users(events, 5), exclusions.named_users(events, F.col("user_id").startswith("staff"), "staff")]
    )
    assert {r["user_id"]: r["reason"] for r in records(excluded)} == {"bot": "bot", "staff-1": "staff"}
    rest = exclusions.without_users(events, excluded)
    keys = {"add_to_cart": "user_id", "begin_checkout": "user_id", "order_completed": "user_id"}
    found = {name: sorted(str(r[keys.get(name, "checkout_id")]) for r in records(df)) for name, df in rest.items()}
    assert found == {
        "add_to_cart": ["None", "ann"],
        "begin_checkout": ["None", "ann"],
        "checkout_step_view": ["None", "ca", "cn", "cx"],
        "form_error": ["None", "ca"],
        "payment_attempt": ["ca"],
        "order_completed": ["None", "ann"],
    }
    for name, df in rest.items():
        assert df.schema.names == events[name].schema.names
    counts = {r["table_name"]: (r["rows"], r["excluded"]) for r in records(exclusions.exclusion_counts(events, excluded))}
    assert counts["payment_attempt"] == (4, 3) and counts["add_to_cart"] == (8, 6)


def test_two_reasons_and_nobody(spark, events):
    both = exclusions.excluded_users([exclusions.fast_users(events, 1), exclusions.named_users(events, F.lit(True), "all")])
    reasons = {r["user_id"]: r["reason"] for r in records(both)}
    assert reasons == {"ann": "all, bot", "bot": "all, bot", "staff-1": "all, bot"}
    nobody = exclusions.fast_users(events, 100)
    rest = exclusions.without_users(events, nobody)
    assert all(rest[name].count() == df.count() for name, df in events.items())


def test_error_abandonment(spark):
    rows = {"begin_checkout": [], "form_error": [], "order_completed": []}
    cells = {("control", True, False): 8, ("control", True, True): 4, ("control", False, False): 5, ("control", False, True): 13, ("treatment", True, False): 3, ("treatment", False, True): 6}
    for (variant, failed, bought), n in cells.items():
        for i in range(n):
            c = f"{variant}{failed}{bought}{i}"
            if i or not failed:  # an error makes a checkout even if its begin is lost
                rows["begin_checkout"].append(begin("u", c, at(1), variant))
            if failed:
                rows["form_error"] += [error(c, "payment", at(2), variant=variant)] * 2
            if bought:
                rows["order_completed"].append(order(c, c, "u", at(3), variant=variant))
    rows["order_completed"].append(order("x", "never begun", "u", at(3)))
    got = {r["variant"]: r for r in records(exclusions.error_abandonment(tables(spark, **rows)))}
    one = got["control"]
    assert (one["with_errors"], one["without_errors"]) == (12, 18)
    assert one["odds_ratio"] == pytest.approx(8 * 13 / 4 / 5)
    spread = math.sqrt(1 / 8 + 1 / 4 + 1 / 5 + 1 / 13)
    assert one["z"] == pytest.approx(math.log(8 * 13 / 20) / spread)
    assert one["ci_high"] == pytest.approx(8 * 13 / 20 * math.exp(1.96 * spread))
    assert one["phi"] == pytest.approx((8 * 13 - 20) / math.sqrt(12 * 18 * 13 * 17))
    assert got["treatment"]["odds_ratio"] == pytest.approx(3.5 * 6.5 / 0.25) and got["treatment"]["phi"] == pytest.approx(1.0)
    assert got["both"]["with_errors"] == 15
    assert records(exclusions.error_abandonment(tables(spark))) == []
