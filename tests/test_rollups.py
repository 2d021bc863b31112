"""Sketch roll-ups, adjusted lift and the monotone power curve."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from frames import cart, order, records, tables, view

from splitlane.operators.adjusted import adjusted_lift
from splitlane.operators.monotone import monotone_rates, sample_size_for_power
from splitlane.operators.sketches import (
    RANK_ERROR,
    USERS_ERROR,
    read_sketches,
    rollup_check,
    store_sketches,
    window_latency,
    window_users,
)

GRID = "uplift double, users_tested long, repeats long, detection_rate double"


def pooled(points):
    """Pool adjacent violators over (size, weight, rate)."""
    blocks = []
    for _, w, v in sorted(points):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return [v for _, v, n in blocks for _ in range(n)]


def test_unsorted_noisy_rates_give_one_rising_curve(spark):
    rng = random.Random(4)
    for trial in range(3):
        rows = [(u, s, rng.choice([10, 20, 50]), round(min(1.0, max(0.0, s / 900 + rng.gauss(0, 0.2))), 3)) for u in (0.01, 0.02) for s in range(100, 1000, 100)]
        rng.shuffle(rows)
        extra = [(0.01, 100, 0, 0.9), (0.01, None, 5, 0.5), (0.01, 300, 5, None)]
        got = records(monotone_rates(spark.createDataFrame(rows + extra, GRID).repartition(3 + trial)))
        for u in (0.01, 0.02):
            curve = sorted((r["users_tested"], r["fitted_rate"]) for r in got if r["uplift"] == u)
            wanted = pooled([(s, w, v) for uplift, s, w, v in rows if uplift == u])
            assert [f for _, f in curve] == pytest.approx(wanted)


def test_sample_sizes_between_grid_points(spark):
    rows = [(0.02, 400, 20, 0.9), (0.02, 100, 20, 0.3), (0.02, 300, 20, 0.5), (0.02, 200, 20, 0.7), (0.01, 100, 20, 0.1), (0.05, 100, 20, 1.0)]
    got = {(r["uplift"], r["target_power"]): r for r in records(sample_size_for_power(spark.createDataFrame(rows, GRID), (0.45, 0.8)))}
    assert got[(0.02, 0.45)]["users_needed"] == 150  # 0.3 at 100, pooled 0.6 from 200 on
    assert got[(0.02, 0.8)]["users_needed"] == math.ceil(300 + 100 * 0.2 / 0.3)
    assert got[(0.01, 0.8)]["users_needed"] is None and not got[(0.01, 0.8)]["within_grid"]
    assert got[(0.05, 0.8)]["users_needed"] == 100 and not got[(0.05, 0.8)]["within_grid"]
    assert records(sample_size_for_power(spark.createDataFrame([], GRID))) == []


@pytest.fixture(scope="module")
def traffic():
    rng = np.random.default_rng(3)
    carts, orders, views = [], [], []
    for n in range(1, 6):
        day, at = dt.date(2025, 1, n), f"2025-01-0{n}T10:00:00Z"
        for i in rng.integers(0, 900, 400).tolist():  # users come back on other days
            variant = "treatment" if i % 2 else "control"
            carts.append(cart(f"u{i}", at, variant, day))
            if i % 3 == 0:
                orders.append(order(f"{n}-{i}", f"c{i}", f"u{i}", at, variant=variant, date=day))
            views.append(view(f"c{i}", "payment", 2, at, int(rng.lognormal(6, 0.5)), variant, day))
    views.append(view("c", "payment", 2, "2025-01-01T10:00:00Z", None))
    return {"add_to_cart": carts, "order_completed": orders, "checkout_step_view": views}


def test_stored_days_roll_up_to_any_window(spark, traffic, tmp_path):
    events, folder = tables(spark, **traffic), str(tmp_path)
    for n in range(1, 6):  # each day's run writes its own day
        store_sketches(events, folder, [dt.date(2025, 1, n)])
    store_sketches(events, folder, [dt.date(2025, 1, 2)])  # and a repeated run replaces it
    stored = read_sketches(spark, folder)
    for first, last in ((None, None), (dt.date(2025, 1, 2), dt.date(2025, 1, 4)), (dt.date(2025, 1, 5), None)):
        inside = [r for r in traffic["add_to_cart"] if (first is None or r[-1] >= first) and (last is None or r[-1] <= last)]
        for row in records(window_users(stored, first, last)):
            exact = len({r[0] for r in inside if r[-2] == row["variant"]})
            assert abs(row["adders"] - exact) <= max(1, 4 * USERS_ERROR * exact)
        assert all(r["within_error"] for r in records(rollup_check(events, stored, first, last)))
    for row in records(window_latency(stored)):
        values = np.array([v[5] for v in traffic["checkout_step_view"] if v[4] == row["variant"] and v[5] is not None])
        assert row["views"] == len(values)
        for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert abs((values <= row[name]).mean() - q) <= 2 * RANK_ERROR + 0.005


def test_a_wrong_sketch_is_seen(spark, traffic, tmp_path):
    events = tables(spark, **traffic)
    half = tables(spark, **{k: v[: len(v) // 2] for k, v in traffic.items()})
    store_sketches(half, str(tmp_path))
    rows = records(rollup_check(events, read_sketches(spark, str(tmp_path))))
    assert not all(r["within_error"] for r in rows)


def test_adjusted_lift_equals_the_normal_equations(spark):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(800):
        day, kind = int(rng.integers(0, 4)), ["new", "old", None][int(rng.integers(0, 3))]
        treated = rng.random() < 0.3 + 0.15 * day  # confounded with the day
        rows.append(("treatment" if treated else "control", day, kind, 1 + 0.5 * treated + 2 * day + (kind == "old") + float(rng.normal())))
    rows += [("holdout", 0, "new", 99.0), ("control", 0, "new", None)]
    df = spark.createDataFrame(rows, "variant string, day int, kind string, v double")
    got = {r["term"]: r for r in records(adjusted_lift(df, "v", ["day", "kind"]))}
    used = [r for r in rows if r[0] != "holdout" and r[3] is not None]
    x = np.array([[1, r[0] == "treatment", r[1] == 1, r[1] == 2, r[1] == 3, r[2] == "new", r[2] == "old"] for r in used], float)
    y = np.array([r[3] for r in used])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    sigma = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    errors = np.sqrt(sigma * np.diag(np.linalg.inv(x.T @ x)))
    names = ["(intercept)", "treatment", "day=1", "day=2", "day=3", "kind=new", "kind=old"]
    assert list(got) == names
    assert [got[n]["estimate"] for n in names] == pytest.approx(beta.tolist())
    assert [got[n]["std_error"] for n in names] == pytest.approx(errors.tolist())
    plain = np.mean([r[3] for r in used if r[0] == "treatment"]) - np.mean([r[3] for r in used if r[0] == "control"])
    assert abs(got["treatment"]["estimate"] - 0.5) < 0.2 < abs(plain - 0.5)


def test_adjusted_lift_where_terms_cannot_be_told_apart(spark):
    rows = [("treatment" if i % 2 else "control", "ab"[i % 2], float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "variant string, s string, v double")
    got = {r["term"]: r for r in records(adjusted_lift(df, "v", ["s"]))}
    assert got["s=b"]["estimate"] is None and got["s=b"]["reason"] == "determined by other terms"
    assert got["treatment"]["estimate"] == pytest.approx(1.0)
    none = records(adjusted_lift(df.limit(0), "v", []))
    assert [r["reason"] for r in none] == ["no rows", "no rows"]
    one = {r["term"]: r for r in records(adjusted_lift(df.limit(1), "v", []))}
    assert one["(intercept)"]["reason"] == "too few rows"
    many = spark.createDataFrame([("control", str(i), 1.0) for i in range(70)], df.schema)
    with pytest.raises(ValueError, match="more than 60 levels"):
        adjusted_lift(many, "v", ["s"])
