"""No day and no variant is lost where one stage has no rows."""

from __future__ import annotations

import datetime as dt

import pytest
from frames import DAY, NEXT, begin, cart, order, payment, records, tables

from splitlane.operators import metrics, readout
from splitlane.operators.guardrails import guardrail_eval


@pytest.fixture(scope="module")
def rows():
    out = {name: [] for name in ("add_to_cart", "begin_checkout", "payment_attempt", "order_completed")}
    for date in (DAY, NEXT):
        for variant in ("control", "treatment"):
            for i in range(3):
                user, at = f"{variant}{i}", f"{date}T1{i}:00:00Z"
                key = f"{user}-{date}"
                out["add_to_cart"].append(cart(user, at, variant, date))
                out["begin_checkout"].append(begin(user, key, at, variant, date))
                out["payment_attempt"].append(payment(key, i > 0, at, variant, date))
                if i:
                    out["order_completed"].append(order(key, key, user, at, 10.0 * i, variant, date))
    return out


def without(spark, rows, table, variant, date=None, column=-2):
    """The event tables without one variant's rows (of one day) in ``table``."""
    def stays(row):
        return row[VARIANT_AT[table]] != variant or (date is not None and row[-1] != date)

    return tables(spark, **{**rows, table: [r for r in rows[table] if stays(r)]})


VARIANT_AT = {"add_to_cart": -2, "begin_checkout": -2, "payment_attempt": -2, "order_completed": -2}


def cells(df, *keys):
    return {tuple(r[k] for k in keys): r for r in records(df)}


def test_guardrails_keep_cells_without_payments_or_orders(spark, rows):
    paid_not = without(spark, rows, "payment_attempt", "control", NEXT)
    got = cells(metrics.guardrails_daily(paid_not), "date", "variant")
    assert len(got) == 4
    lost = got[(NEXT, "control")]
    assert (lost["total_attempts"], lost["authorized"], lost["auth_rate"]) == (0, 0, None)
    assert (lost["order_count"], lost["aov"], lost["missing"]) == (2, 15.0, "payments")
    assert got[(DAY, "control")]["missing"] is None
    newest = cells(metrics.guardrails(paid_not), "variant")
    assert newest[("control",)]["order_count"] == 2 and len(newest) == 2
    unsold = cells(metrics.guardrails_daily(without(spark, rows, "order_completed", "treatment")), "date", "variant")
    assert len(unsold) == 4 and unsold[(DAY, "treatment")]["missing"] == "orders"
    assert unsold[(DAY, "treatment")]["total_attempts"] == 3 and unsold[(DAY, "treatment")]["aov"] is None


def test_what_is_read_off_the_guardrails_keeps_them_too(spark, rows):
    events = without(spark, rows, "payment_attempt", "control", NEXT)
    summary = cells(readout.guardrails_summary(events), "date", "variant")
    assert len(summary) == 4 and summary[(NEXT, "control")]["mean_order_value"] == 15.0
    assert summary[(NEXT, "control")]["rate"] is None
    judged = cells(guardrail_eval(events), "date", "metric")
    assert not judged[(NEXT, "payment_auth_rate")]["passed"] and judged[(NEXT, "aov")]["passed"]
    assert len(records(readout.aa_parity(events))) >= 1


@pytest.mark.parametrize("table", ["add_to_cart", "begin_checkout", "payment_attempt", "order_completed"])
def test_funnels_keep_a_variant_without_one_stage(spark, rows, table):
    events = without(spark, rows, table, "control")
    stage = {"add_to_cart": "adders", "begin_checkout": "begin_checkout", "payment_attempt": "payment_attempts", "order_completed": "orders"}
    for build in (metrics.variant_funnel, metrics.funnel_summary):
        got = cells(build(events, NEXT), "variant")
        assert set(got) == {("control",), ("treatment",)}
        full = {"adders": 3, "begin_checkout": 3, "payment_attempts": 3, "orders": 2}
        shown = {s: got[("control",)][s] for s in full}
        assert shown == {**full, stage[table]: 0}
    rate = cells(metrics.funnel_summary(events, NEXT), "variant")[("control",)]["conditional_conversion_pct"]
    assert rate == {"add_to_cart": None, "order_completed": 0.0}.get(table, 66.7)


def test_days_without_first_exposures_stay_with_their_reason(spark, rows):
    events = tables(spark, **rows)
    got = cells(metrics.ccr_first_exposure(events), "date", "variant")
    assert {k: (r["adders"], r["orders"]) for k, r in got.items()} == {
        (DAY, "control"): (3, 2), (DAY, "treatment"): (3, 2), (NEXT, "control"): (0, 2), (NEXT, "treatment"): (0, 2),
    }
    summary = cells(readout.ccr_summary(events), "date")
    assert summary[(NEXT,)]["invalid_reason"] == "no observations" and not summary[(NEXT,)]["significant"]
    orders_only = without(spark, rows, "add_to_cart", "control", NEXT)
    assert cells(metrics.ccr_first_exposure(orders_only), "date", "variant")[(NEXT, "control")]["orders"] == 2
    no_orders = without(spark, rows, "order_completed", "treatment", NEXT)
    assert cells(metrics.ccr_first_exposure(no_orders), "date", "variant")[(NEXT, "treatment")]["orders"] == 0


def test_rows_without_a_variant_are_one_cell(spark):
    at = "2025-01-01T10:00:00Z"
    events = tables(
        spark,
        payment_attempt=[payment("c", True, at, None), payment("d", False, at, None)],
        order_completed=[order("1", "c", "u", at, 5.0, None)],
    )
    (row,) = records(metrics.guardrails_daily(events))
    assert (row["variant"], row["total_attempts"], row["order_count"], row["missing"]) == (None, 2, 1, None)
    assert row["date"] == dt.date(2025, 1, 1)
