from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
import statistics

import pytest
from frames import cart, one, order, records, tables

from splitlane.operators import power, power_tables, resampling
from splitlane.operators.metrics import user_days
from splitlane.operators.power import PowerGrid

GRID_SCHEMA = (
    "users_per_day bigint, users_tested bigint, uplift double, repeats bigint, detections bigint,"
    " detection_rate double, alpha double"
)


def published_grid(spark):
    """Detections of 20 repeats at three sample sizes, as published."""
    found = {
        20_000: (0, 3, 13, 19),
        50_000: (1, 9, 18, 20),
        100_000: (4, 13, 20, 20),
    }
    rows = [
        (n, n, u, 20, d, d / 20, 0.05)
        for n, counts in found.items()
        for u, d in zip((0.0, 0.01, 0.02, 0.03), counts)
    ]
    return spark.createDataFrame(rows, GRID_SCHEMA)


def traffic(spark, users=600, rate=0.3, seed=11):
    rng = random.Random(seed)
    carts, orders = [], []
    for i in range(users):
        variant = rng.choice(["control", "treatment"])
        carts.append(cart(f"u{i}", "2025-01-01T01:00:00Z", variant))
        if rng.random() < rate:
            orders.append(order(f"o{i}", f"c{i}", f"u{i}", "2025-01-01T02:00:00Z", variant=variant))
    return tables(spark, add_to_cart=carts, order_completed=orders)


def test_near_mde_excludes_the_float_boundary(spark):
    row = one(power_tables.power_near_mde(published_grid(spark)))
    assert (row["users_per_day"], row["uplift"], row["near_mde"]) == (100_000, 0.01, True)


def test_without_a_near_point_the_closest_is_shown(spark):
    grid = published_grid(spark).where("uplift <> 0.01")
    row = one(power_tables.power_near_mde(grid))
    assert (row["users_per_day"], row["uplift"], row["near_mde"]) == (20_000, 0.02, False)


def test_ties_go_to_the_smaller_sample(spark):
    best = {r["uplift"]: r for r in records(power_tables.power_best_by_uplift(published_grid(spark)))}
    assert set(best) == {0.01, 0.02, 0.03}
    assert best[0.03]["users_per_day"] == 50_000
    assert best[0.02]["users_per_day"] == 100_000


def test_curve_sizes_and_shape(spark):
    grid = published_grid(spark)
    curve = records(power_tables.power_curve(grid).orderBy("uplift_pct"))
    assert [(r["smallest"], r["largest"]) for r in curve] == [(0.15, 0.65), (0.65, 1.0), (0.95, 1.0)]
    assert one(power_tables.power_grid_shape(grid)) == {
        "grid_points": 12,
        "sample_sizes": 3,
        "uplifts": 4,
        "total_runs": 240,
    }
    needed = {
        (r["uplift"], r["target_pct"]): (r["reached"], r["users_tested"])
        for r in records(power_tables.sample_size_table(grid))
    }
    assert needed[(0.02, 80)] == (True, 50_000)
    assert needed[(0.01, 50)] == (True, 100_000)
    assert needed[(0.01, 80)] == (False, 100_000)
    aa = {r["users_per_day"]: r["detection_rate"] for r in records(power_tables.false_positive_rate(grid))}
    assert aa == {20_000: 0.0, 50_000: 0.05, 100_000: 0.2}


def digest(unit, salt):
    return hashlib.md5(f"{unit}:{salt}".encode()).hexdigest()


def p_value(s_a, n_a, s_b, n_b):
    pooled = (s_a + s_b) / (n_a + n_b)
    se = math.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b))
    return math.erfc(abs(s_b / n_b - s_a / n_a) / se / math.sqrt(2)) if se else 1.0


def returning_traffic(spark, users=300, seed=5):
    """Users with one to four cart days, and a user-less cart row."""
    rng = random.Random(seed)
    carts, orders = [cart(None, "2025-01-01T01:00:00Z", "control")], []
    for i in range(users):
        variant = rng.choice(["control", "treatment"])
        for n in range(1, rng.randint(1, 4) + 1):
            day, at = dt.date(2025, 1, n), f"2025-01-0{n}T01:00:00Z"
            carts.append(cart(f"u{i}", at, variant, date=day))
            if rng.random() < 0.3:
                orders.append(order(f"o{i}-{n}", f"c{i}-{n}", f"u{i}", at, variant=variant, date=day))
    return tables(spark, add_to_cart=carts, order_completed=orders)


def user_totals(events):
    totals = {}
    for r in records(user_days(events)):
        if r["user_id"] is not None:
            days, bought = totals.get(r["user_id"], (0, 0))
            totals[r["user_id"]] = (days + 1, bought + r["converted"])
    return totals


def expected_cells(totals, plan, rate, copies, thresholds):
    """Counts per (replicate, size, uplift): {variant: [orders, user-days]}."""
    cells = {}
    for rep in range(plan.repeats):
        for user, (days, bought) in totals.items():
            for copy in range(1, copies + 1):
                d = digest(user if copy == 1 else f"{user}#{copy}", f"replicate{rep}")
                variant = "treatment" if int(d, 16) % 2 == 0 else "control"
                for size, cut in thresholds.items():
                    for uplift in plan.uplifts:
                        found = cells.setdefault((rep, size, uplift), {"control": [0, 0], "treatment": [0, 0]})
                        if int(d[:8], 16) >= math.floor(cut * 2**32):
                            continue
                        flip = variant == "treatment" and int(d[8:16], 16) < math.floor(
                            rate * uplift / (1 - rate) * 2**32
                        )
                        found[variant][1] += days
                        found[variant][0] += days if flip else bought
    return cells


def detections(cells):
    found = {}
    for (_, size, uplift), arms in cells.items():
        (s_a, n_a), (s_b, n_b) = arms["control"], arms["treatment"]
        found.setdefault((size, uplift), 0)
        found[(size, uplift)] += p_value(s_a, n_a, s_b, n_b) < 0.05
    return found


def test_grid_against_brute_force(spark):
    events = returning_traffic(spark)
    plan = PowerGrid(sample_pcts=(40, 100, 150), uplifts=(0.0, 0.5), repeats=8)
    totals = user_totals(events)
    assert max(days for days, _ in totals.values()) == 4
    rate = sum(b for _, b in totals.values()) / sum(d for d, _ in totals.values())
    shares = {pct: pct / 100 / 2 for pct in plan.sample_pcts}
    expected = detections(expected_cells(totals, plan, rate, 2, shares))
    grid = {
        (r["users_tested"], r["uplift"]): r["detections"]
        for r in records(power.detection_grid(events, plan))
    }
    assert grid == {(math.floor(300 * pct / 100), u): n for (pct, u), n in expected.items()}
    assert grid[(300, 0.5)] > grid[(300, 0.0)]


def test_stated_users_per_day_are_tested_on_the_first_day(spark):
    events = returning_traffic(spark)
    plan = PowerGrid(users_per_day=(100, 450), uplifts=(0.5,), repeats=6)
    totals = {}
    for r in records(user_days(events)):
        if r["user_id"] is not None and str(r["date"]) == "2025-01-01":
            totals[r["user_id"]] = (1, int(r["converted"]))
    assert len(totals) == 300
    rate = statistics.mean(b for _, b in totals.values())
    shares = {n: n / 300 / 2 for n in plan.users_per_day}
    cells = expected_cells(totals, plan, rate, 2, shares)
    points = {
        (r["replicate"], r["users_per_day"]): (r["control_adders"], r["treatment_adders"])
        for r in records(power.grid_points(events, plan))
    }
    assert points == {(rep, n): (a["control"][1], a["treatment"][1]) for (rep, n, _), a in cells.items()}
    grid = {
        (r["users_per_day"], r["users_tested"]): r["detections"]
        for r in records(power.detection_grid(events, plan))
    }
    assert grid == {(n, n): found for (n, _), found in detections(cells).items()}


def test_no_user_is_in_two_arms_of_a_replicate(spark):
    events = returning_traffic(spark)
    dealt = power.with_digests(power.known_user_days(events), [], 10, "replicate")
    rows = records(dealt)
    assert len(rows) == 300 * 10
    assert len({(r["user_id"], r["replicate"]) for r in rows}) == len(rows)


def test_untestable_replicates_stay_in_the_denominator(spark):
    events = tables(spark, add_to_cart=[cart("only", "2025-01-01T01:00:00Z")])
    rows = records(power.detection_grid(events, PowerGrid(repeats=4)))
    assert {r["users_tested"] for r in rows} == {0, 1}
    assert len(rows) == 12
    assert all(r["detections"] == 0 and r["repeats"] == 4 for r in rows)


def test_false_positives_stay_near_alpha(spark):
    grid = PowerGrid(sample_pcts=(100,), uplifts=(0.0,), repeats=300)
    row = one(power.detection_grid(traffic(spark), grid))
    assert 0.01 <= row["detection_rate"] <= 0.10


def test_everyone_converting_needs_no_flip(spark):
    rows = records(power.detection_grid(traffic(spark, users=50, rate=1.1), PowerGrid(repeats=2)))
    assert all(r["detections"] == 0 for r in rows)


def test_bootstrap_interval_surrounds_the_effect(spark):
    events = traffic(spark)
    row = one(resampling.bootstrap_ci(events, repeats=200))
    assert row["replicates"] == 200
    assert row["ci_low"] < row["effect_mean"] < row["ci_high"]
    arms = {}
    for r in records(user_days(events)):
        arms.setdefault(r["variant"], []).append(r["converted"])
    gap = statistics.mean(arms["treatment"]) - statistics.mean(arms["control"])
    assert row["effect_mean"] == pytest.approx(gap, abs=0.01)
    se = math.sqrt(sum(statistics.pvariance(map(int, a)) / len(a) for a in arms.values()))
    assert row["effect_std"] == pytest.approx(se, rel=0.2)


def test_permutation_p_value(spark):
    row = one(resampling.permutation_test(traffic(spark), repeats=50))
    assert row["replicates"] == 50
    assert row["p_value"] == pytest.approx((row["as_extreme"] + 1) / 51)


def test_adjusted_p_values(spark):
    raw = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.005, "e": None}
    tests = spark.createDataFrame(
        [("f", t, p) for t, p in raw.items()], "family string, test string, p_value double"
    )
    rows = {r["test"]: r for r in records(resampling.adjust_p_values(tests, "family", "p_value"))}
    expected = {
        # test: bonferroni, holm, benjamini_hochberg
        "d": (0.02, 0.02, 0.02),
        "a": (0.04, 0.03, 0.02),
        "c": (0.12, 0.06, 0.04),
        "b": (0.16, 0.06, 0.04),
    }
    for test, values in expected.items():
        got = [rows[test][k] for k in ("bonferroni", "holm", "benjamini_hochberg")]
        assert got == pytest.approx(values)
    assert rows["e"]["holm"] is None


def test_interaction_of_two_segments(spark):
    lifts = spark.createDataFrame(
        [("new", 0.2, 0.3, 0.1, 100, 100), ("returning", 0.4, 0.4, 0.0, 200, 200)],
        "segment string, p_a double, p_b double, effect_abs double,"
        " control_adders bigint, treatment_adders bigint",
    )
    row = one(resampling.interaction_test(lifts, "segment", "new", "returning"))
    se = math.sqrt(0.16 / 100 + 0.21 / 100 + 2 * 0.24 / 200)
    assert row["z"] == pytest.approx(-0.1 / se)
    assert row["p_value"] == pytest.approx(math.erfc(0.1 / se / math.sqrt(2)))
