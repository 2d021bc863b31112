"""Stopping boundaries against published tables, simulated paths and re-dealt traffic."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from frames import cart, order, records, tables

from splitlane.functions.sequential import (
    always_valid_p,
    equal_looks,
    spending_boundaries,
)
from splitlane.operators.sequential import early_stopping_errors, interim_looks


@pytest.mark.parametrize(
    ("rule", "published"),
    [
        ("obrien_fleming", (4.8769, 3.3569, 2.6803, 2.2898, 2.0310)),
        ("pocock", (2.4380, 2.4268, 2.4101, 2.3966, 2.3859)),
    ],
)
def test_boundaries_of_five_equal_looks_are_the_published_ones(rule, published):
    assert spending_boundaries(equal_looks(5), 0.05, rule) == pytest.approx(published, abs=2e-4)


def test_one_look_is_the_plain_test_and_empty_looks_never_stop():
    assert spending_boundaries([1.0]) == pytest.approx([1.959964], abs=1e-5)
    got = spending_boundaries([0.0, 0.5, 0.5, 1.0, 1.2])
    assert [math.isinf(b) for b in got] == [True, False, True, False, True]
    assert spending_boundaries([0.5, 1.0]) == pytest.approx([got[1], got[3]])
    with pytest.raises(ValueError, match="shrink"):
        spending_boundaries([0.5, 0.4])
    with pytest.raises(ValueError, match="alpha"):
        spending_boundaries([1.0], alpha=1.5)


@pytest.mark.parametrize("rule", ["obrien_fleming", "pocock"])
@pytest.mark.parametrize("information", [equal_looks(30), [0.02, 0.3, 0.31, 0.9, 1.0]])
def test_simulated_paths_cross_with_alpha(rule, information):
    rng = np.random.default_rng(5)
    steps = np.diff([0.0, *information])
    paths = np.cumsum(rng.normal(size=(200_000, len(steps))) * np.sqrt(steps), axis=1)
    z = np.abs(paths) / np.sqrt(information)
    crossed = (z >= np.array(spending_boundaries(information, 0.05, rule))).any(axis=1).mean()
    assert crossed == pytest.approx(0.05, abs=0.002)


def test_always_valid_p_is_the_mixture_ratio(spark):
    rows = [(0.0, 0.0001), (0.01, 0.0001), (0.05, 0.0001), (-0.05, 0.0001), (0.3, 0.0), (0.3, None)]
    df = spark.createDataFrame(rows, "e double, v double")
    got = [r.p for r in df.select(always_valid_p(df.e, df.v, 0.02).alias("p")).collect()]
    t = 0.0004
    for (e, v), p in zip(rows, got, strict=True):
        ratio = math.sqrt(v / (v + t)) * math.exp(t * e * e / (2 * v * (v + t))) if v else 0
        assert p == pytest.approx(min(1.0, 1 / ratio) if ratio else 1.0)


def day(n):
    return dt.date(2025, 1, n)


def test_users_count_once_from_their_first_day(spark):
    at = "2025-01-0{}T10:00:00Z"
    events = tables(
        spark,
        add_to_cart=[
            cart("a", at.format(1), date=day(1)),
            cart("a", at.format(2), date=day(2)),
            cart("b", at.format(2), "treatment", day(2)),
            cart(None, at.format(2), "treatment", day(2)),
            cart("c", at.format(4), date=day(4)),
        ],
        order_completed=[
            order("1", "x", "a", at.format(2), date=day(2)),
            order("2", "y", "b", at.format(2), variant="treatment", date=day(2)),
            order("3", "z", "b", at.format(3), variant="treatment", date=day(3)),
        ],
    )
    rows = records(interim_looks(events, looks=3).orderBy("look"))
    names = ("date", "control_adders", "control_orders", "treatment_adders", "treatment_orders")
    assert [tuple(r[n] for n in names) for r in rows] == [
        (day(1), 1, 0, 0, 0),
        (day(2), 1, 1, 1, 1),
        (day(4), 2, 1, 1, 1),
    ]
    assert rows[0]["z"] is None and not rows[0]["stop_pocock"] and rows[0]["always_valid_p"] == 1.0
    planned = records(interim_looks(events, planned_users=6).orderBy("look"))
    assert [r["boundary_pocock"] for r in planned] == pytest.approx(spending_boundaries([1 / 6, 2 / 6, 3 / 6], 0.05, "pocock"))


def test_a_large_effect_stops_every_rule_and_stays_stopped(spark):
    carts, orders = [], []
    for n in range(1, 9):
        for i in range(60):
            variant = "treatment" if i % 2 else "control"
            user, at = f"u{n}-{i}", f"2025-01-0{n}T10:00:00Z"
            carts.append(cart(user, at, variant, day(n)))
            if variant == "treatment" or i % 4 == 0:
                orders.append(order(user, user, user, at, variant=variant, date=day(n)))
    rows = records(interim_looks(tables(spark, add_to_cart=carts, order_completed=orders), looks=8, tau=0.2).orderBy("look"))
    for rule in ("obrien_fleming", "pocock", "always_valid"):
        stopped = [r[f"stopped_{rule}"] for r in rows]
        assert stopped[-1] and stopped == sorted(stopped)
    assert [r["stop_obrien_fleming"] for r in rows].index(True) >= [r["stop_pocock"] for r in rows].index(True)


def test_rules_hold_alpha_over_thirty_looks_at_re_dealt_traffic(spark):
    rng = np.random.default_rng(8)
    carts, orders = [], []
    for i in range(1500):  # users with several days, so that days of one user are tied
        first = int(rng.integers(1, 31))
        buys = rng.random() < 0.3
        for n in sorted({first, *rng.integers(first, 31, 2).tolist()}):
            at = f"2025-01-{n:02d}T10:00:00Z"
            carts.append(cart(f"u{i}", at, date=day(n)))
            if buys and rng.random() < 0.7:
                orders.append(order(f"{i}-{n}", f"{i}-{n}", f"u{i}", at, date=day(n)))
    events = tables(spark, add_to_cart=carts, order_completed=orders)
    repeats = 400
    rows = {r["rule"]: r for r in records(early_stopping_errors(events, repeats))}
    noise = 2 * math.sqrt(0.05 * 0.95 / repeats)
    assert rows["every_look"]["looks"] == 30
    for rule in ("obrien_fleming", "pocock", "always_valid"):
        assert rows[rule]["false_positive_rate"] <= 0.05 + noise, rule
    assert rows["every_look"]["false_positive_rate"] > 0.15
