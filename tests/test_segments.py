"""Clustered effects, chi-square tails and tests over many segments and arms."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from frames import cart, order, records, tables
from pyspark.sql import functions as F

from splitlane.functions.chi_square import chi_square_tail
from splitlane.operators.clustered import (
    cluster_estimates,
    cluster_moments,
    clustered_effect,
    clustered_effects,
)
from splitlane.operators.segments import effect_heterogeneity, split_homogeneity, split_test


def tail(spark, x, d):
    df = spark.createDataFrame([(x, d)], "x double, d int")
    return df.select(chi_square_tail(F.col("x"), F.col("d")).alias("p")).head()[0]


# Upper 5 and 1 per cent points of published chi-square tables.
@pytest.mark.parametrize(
    ("d", "five", "one"),
    [
        (1, 3.8415, 6.6349), (2, 5.9915, 9.2103), (3, 7.8147, 11.3449), (4, 9.4877, 13.2767),
        (10, 18.3070, 23.2093), (19, 30.1435, 36.1909), (30, 43.7730, 50.8922), (100, 124.342, 135.807),
    ],
)
def test_chi_square_tail_equals_the_tables(spark, d, five, one):
    assert tail(spark, five, d) == pytest.approx(0.05, rel=2e-4)
    assert tail(spark, one, d) == pytest.approx(0.01, rel=4e-4)


def test_chi_square_tail_at_its_edges(spark):
    assert tail(spark, 0.0, 3) == tail(spark, -1.0, 3) == 1.0
    assert tail(spark, None, 3) is tail(spark, 1.0, None) is tail(spark, 1.0, 0) is tail(spark, math.nan, 2) is None
    assert tail(spark, 1e6, 5) == 0.0
    assert tail(spark, 1400.0, 2) == pytest.approx(math.exp(-700), rel=1e-9)
    assert tail(spark, 999.333, 1000) == pytest.approx(0.5, abs=1e-3)


def clustered(rng, clusters):
    """Rows of clusters of unequal size that share a level."""
    rows = []
    for variant, lift in (("control", 0.0), ("treatment", 0.4)):
        for c in range(clusters):
            level = rng.gauss(5 + lift, 1)
            rows += [("m", variant, f"{variant}{c}", level + rng.gauss(0, 1)) for _ in range(rng.randint(1, 9))]
    return rows


def test_clustered_estimates_equal_a_plain_fit(spark):
    rows = clustered(random.Random(3), 60)
    extra = [("m", "control", None, 100.0), ("m", "treatment", "treatment0", None)]
    df = spark.createDataFrame(rows + extra, "metric string, variant string, user string, v double")
    got = {r["variant"]: r for r in records(cluster_estimates(cluster_moments(df, ["metric", "variant"], "user", "v"), ["metric", "variant"]))}
    fits = {}
    for variant in ("control", "treatment"):
        groups = {}
        for _, v, c, y in rows:
            if v == variant:
                groups.setdefault(c, []).append(y)
        x = np.array([len(g) for g in groups.values()], float)
        y = np.array([sum(g) for g in groups.values()])
        values = np.concatenate([np.array(g) for g in groups.values()])
        n, mean = len(x), y.sum() / x.sum()
        variance = n / (n - 1) * ((y - mean * x) ** 2).sum() / x.sum() ** 2
        within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values()) / (x.sum() - n)
        among = (x * (y / x - mean) ** 2).sum() / (n - 1)
        size = (x.sum() - (x**2).sum() / x.sum()) / (n - 1)
        row = got[variant]
        assert row["clusters"] == n and row["rows"] == len(values)
        assert row["mean"] == pytest.approx(mean)
        assert row["variance"] == pytest.approx(variance)
        assert row["icc"] == pytest.approx((among - within) / (among + (size - 1) * within))
        assert row["design_effect"] == pytest.approx(variance / (values.var(ddof=1) / len(values)))
        assert 0.3 < row["icc"] < 0.7 and row["design_effect"] > 2
        fits[variant] = mean, variance
    assert got["control"]["unclustered_rows"] == 1
    effect = records(clustered_effect(cluster_estimates(cluster_moments(df, ["metric", "variant"], "user", "v"), ["metric", "variant"]), ["metric"]))[0]
    gap, error = fits["treatment"][0] - fits["control"][0], math.sqrt(fits["treatment"][1] + fits["control"][1])
    assert effect["z"] == pytest.approx(gap / error)
    assert effect["p_value"] == pytest.approx(math.erfc(abs(gap / error) / math.sqrt(2)), rel=1e-6)
    assert effect["ci_high"] - effect["ci_low"] == pytest.approx(2 * 1.96 * error)


def test_clustered_errors_hold_alpha_where_plain_ones_do_not(spark):
    rng = random.Random(9)
    rows = []
    for trial in range(300):
        for c in range(60):
            level = rng.gauss(0, 1)
            rows += [(str(trial), "control" if c % 2 else "treatment", str(c), level + rng.gauss(0, 0.5)) for _ in range(6)]
    df = spark.createDataFrame(rows, "metric string, variant string, user string, v double")
    by = ["metric", "variant"]
    tests = records(clustered_effect(cluster_estimates(cluster_moments(df, by, "user", "v"), by), ["metric"]))
    assert np.mean([t["p_value"] < 0.05 for t in tests]) < 0.05 + 2 * math.sqrt(0.05 * 0.95 / 300) + 0.01
    plain = [abs(t["z"]) * math.sqrt((t["control_design_effect"] + t["treatment_design_effect"]) / 2) > 1.96 for t in tests]
    assert np.mean(plain) > 0.2


def test_clustered_effects_with_a_missing_variant_or_one_user(spark):
    day = dt.date(2025, 1, 1)
    events = tables(
        spark,
        add_to_cart=[cart("a", "2025-01-01T10:00:00Z"), cart("b", "2025-01-01T10:00:00Z", "treatment")],
        order_completed=[order("1", "x", "a", "2025-01-01T11:00:00Z", date=day)],
    )
    rows = {r["metric"]: r for r in records(clustered_effects(events))}
    assert rows["conversion"]["invalid_reason"] == "fewer than two clusters"
    assert rows["order_value"]["invalid_reason"] == "missing variant"
    assert rows["conversion"]["effect_abs"] == -1.0 and rows["conversion"]["p_value"] is None
    assert records(clustered_effects(tables(spark))) == []


LIFT = "cut string, p_a double, p_b double, effect_abs double, control_adders long, treatment_adders long"


def test_heterogeneity_of_many_segments(spark):
    rng = np.random.default_rng(2)
    rows, wanted = [], {}
    for cut, k in (("same", 5), ("wide", 12), ("one", 1)):
        w, e = [], []
        for j in range(k):
            p_a, p_b = 0.2, 0.22 + (0.01 * j if cut == "wide" else 0) + float(rng.normal(0, 0.001))
            n, m = int(rng.integers(800, 2000)), int(rng.integers(800, 2000))
            rows.append((cut, p_a, p_b, p_b - p_a, n, m))
            w.append(1 / (p_a * (1 - p_a) / n + p_b * (1 - p_b) / m))
            e.append(p_b - p_a)
        w, e = np.array(w), np.array(e)
        wanted[cut] = (w * (e - (w * e).sum() / w.sum()) ** 2).sum()
    rows += [("same", None, None, None, 0, 5), ("same", 0.0, 0.0, 0.0, 9, 9)]
    got = {r["cut"]: r for r in records(effect_heterogeneity(spark.createDataFrame(rows, LIFT), ["cut"]))}
    assert got["same"]["q"] == pytest.approx(wanted["same"], abs=1e-9) and got["wide"]["q"] == pytest.approx(wanted["wide"])
    assert (got["same"]["segments"], got["same"]["left_out"], got["same"]["degrees"]) == (5, 2, 4)
    assert got["wide"]["differs"] and not got["same"]["differs"]
    assert got["one"]["degrees"] is None and got["one"]["p_value"] is None and not got["one"]["differs"]


def test_splits_over_three_arms(spark):
    rows = [("a", "x", 480), ("a", "y", 260), ("a", "z", 260), ("b", "x", 900), ("b", "y", 100), ("c", "x", 50), ("c", "y", 25), ("c", "z", 25), ("c", "new", 1)]
    df = spark.createDataFrame(rows, "cut string, arm string, n long")
    got = {r["cut"]: r for r in records(split_test(df, ["cut"], {"x": 2, "y": 1, "z": 1}))}
    chi = 20**2 / 500 + 2 * 10**2 / 250
    assert got["a"]["chi_square"] == pytest.approx(chi) and got["a"]["degrees"] == 2
    assert got["a"]["p_value"] == pytest.approx(math.exp(-chi / 2)) and not got["a"]["mismatch"]
    assert got["b"]["mismatch"] and got["b"]["users"] == 1000  # no user of z at all
    assert got["c"]["chi_square"] == 0 and got["c"]["unplanned_users"] == 1 and got["c"]["mismatch"]
    with pytest.raises(ValueError, match="share above 0"):
        split_test(df, ["cut"], {"x": 1, "y": 0})


def test_homogeneity_of_a_table_with_empty_cells(spark):
    table = np.array([[30, 20, 0], [25, 30, 5], [40, 35, 9], [0, 3, 2]])
    rows = [("t", f"s{i}", f"arm{j}", int(n)) for i, line in enumerate(table) for j, n in enumerate(line)]
    got = records(split_homogeneity(spark.createDataFrame(rows, "cut string, segment string, arm string, n long"), ["cut"], "segment"))[0]
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    chi = ((table - expected) ** 2 / expected).sum()
    assert got["chi_square"] == pytest.approx(chi) and got["degrees"] == 6 and got["users"] == table.sum()
    half = chi / 2
    assert got["p_value"] == pytest.approx(math.exp(-half) * (1 + half + half**2 / 2))
