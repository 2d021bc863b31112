"""Rank, distance and change-point tests against plain Python."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from frames import error, records, tables, view
from pyspark.sql import functions as F

from splitlane.functions.kolmogorov import kolmogorov_tail
from splitlane.operators.distributions import change_points, distribution_tests, hourly_changes, running_counts

ROW = "step string, variant string, v long"


# Published upper points of the Kolmogorov distribution.
def test_kolmogorov_tail_equals_the_table(spark):
    table = {0.01: 1.6276, 0.05: 1.3581, 0.10: 1.2238, 0.20: 1.0728, 0.5: 0.8276, 0.9: 0.5712}
    df = spark.createDataFrame([(x,) for x in [*table.values(), 0.0, 9.0, 1.1999999, 1.2000001]], "x double")
    got = [r[0] for r in df.select(kolmogorov_tail(F.col("x"))).collect()]
    assert got[: len(table)] == pytest.approx(list(table), abs=2e-4)
    assert got[-4] == 1.0 and got[-3] < 1e-60 and got[-2] == pytest.approx(got[-1], abs=1e-6)
    assert spark.range(1).select(kolmogorov_tail(F.lit(None).cast("double"))).head()[0] is None


def plain(c, t):
    c, t = np.array(c, float), np.array(t, float)
    u = sum((t[:, None] > c[None, :]).sum(1)) + 0.5 * (t[:, None] == c[None, :]).sum()
    every = np.concatenate([c, t])
    n = len(every)
    ties = sum(k**3 - k for k in np.unique(every, return_counts=True)[1])
    sd = math.sqrt(len(c) * len(t) / 12 * (n + 1 - ties / (n * (n - 1))))
    points = np.unique(every)
    gaps = [abs((c <= x).mean() - (t <= x).mean()) for x in points]
    return u / len(c) / len(t), (u - len(c) * len(t) / 2) / sd, max(gaps), points[int(np.argmax(np.round(gaps, 12)))]


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_both_tests_with_many_ties_equal_plain_python(spark, piece):
    rng = np.random.default_rng(4)
    data = {
        "tied": (rng.integers(0, 6, 80), rng.integers(0, 7, 120)),
        "wide": (rng.integers(0, 5000, 150), rng.integers(0, 5000, 90)),
        "negative": (rng.integers(-50, 5, 70), rng.integers(-45, 15, 60)),
        None: (np.array([1, 2, 2]), np.array([2, 3])),
    }
    rows = [(s, v, int(x)) for s, pair in data.items() for v, xs in zip(("control", "treatment"), pair, strict=True) for x in xs]
    rows += [("tied", "treatment", None), ("tied", "holdout", 3), ("tied", None, 3), ("lone", "control", 5), ("flat", "control", 1), ("flat", "treatment", 1)]
    df = spark.createDataFrame(rows, ROW)
    got = {r["step"]: r for r in records(distribution_tests(df, ["step"], "v", piece=piece))}
    for step, pair in data.items():
        superiority, z, distance, at = plain(*pair)
        row = got[step]
        assert (row["control_rows"], row["treatment_rows"]) == tuple(map(len, pair))
        assert row["superiority"] == pytest.approx(superiority) and row["z"] == pytest.approx(z)
        assert row["distance"] == pytest.approx(distance) and row["distance_at"] == at
        assert row["rank_p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)
    assert got["lone"]["z"] is None and got["lone"]["distance"] is None and not got["lone"]["differs"]
    assert got["flat"]["z"] is None and got["flat"]["distance"] == 0 and got["flat"]["distance_p_value"] == 1.0


def test_running_counts_do_not_depend_on_pieces(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("s", "control" if i % 3 else "treatment", int(x)) for i, x in enumerate(rng.integers(-300, 300, 500))], ROW)
    whole, cut = (sorted(map(tuple, running_counts(df, ["step"], "v", p).collect())) for p in (10**9, 3))
    assert whole == cut


def test_both_tests_hold_alpha_and_see_different_changes(spark):
    rng = np.random.default_rng(6)
    rows = []
    for trial in range(150):
        for v in ("control", "treatment"):
            rows += [(f"same{trial}", v, int(x)) for x in rng.normal(1000, 100, 60)]
    for v, scale in (("control", 30), ("treatment", 300)):  # equal medians, other spread
        rows += [("spread", v, int(x)) for x in rng.normal(1000, scale, 300)]
    for v, mean in (("control", 1000), ("treatment", 1040)):
        rows += [("shift", v, int(x)) for x in rng.normal(mean, 100, 400)]
    got = {r["step"]: r for r in records(distribution_tests(spark.createDataFrame(rows, ROW), ["step"], "v"))}
    same = [r for s, r in got.items() if s.startswith("same")]
    assert np.mean([r["differs"] for r in same]) <= 0.05 + 2 * math.sqrt(0.05 * 0.95 / 150)
    assert got["spread"]["distance_p_value"] < 1e-6 < got["spread"]["rank_p_value"]
    assert got["shift"]["rank_p_value"] < 1e-4 and got["shift"]["superiority"] > 0.55


def test_a_planted_shift_is_found_on_its_day_and_none_on_flat_data(spark):
    rng = np.random.default_rng(7)
    start = dt.datetime(2025, 1, 1)
    rows = []
    for trial in range(120):
        rows += [(f"flat{trial}", start + dt.timedelta(hours=h), float(rng.normal(5, 1))) for h in range(240)]
    rows += [("shift", start + dt.timedelta(hours=h), float(rng.normal(5 + 1.0 * (h >= 140), 1))) for h in range(240)]
    rows += [("spike", start + dt.timedelta(hours=h), float(rng.normal(5, 1) + 300 * (h == 50))) for h in range(240)]
    rows += [("short", start, 1.0), ("short", start + dt.timedelta(hours=1), 2.0), ("still", start, None)]
    rows += [("constant", start + dt.timedelta(hours=h), 3.0) for h in range(50)]
    df = spark.createDataFrame(rows, "series string, hour timestamp_ntz, value double")
    got = {r["series"]: r for r in records(change_points(df, ["series"], "hour", "value"))}
    flat = [r["changed"] for s, r in got.items() if s.startswith("flat")]
    assert np.mean(flat) <= 0.05 + 2 * math.sqrt(0.05 * 0.95 / 120)
    shift = got["shift"]
    assert shift["changed"] and abs(shift["change_at"] - (start + dt.timedelta(hours=140))) <= dt.timedelta(hours=6)
    assert shift["mean_before"] == pytest.approx(5, abs=0.3) and shift["mean_after"] == pytest.approx(6, abs=0.3)
    assert not got["spike"]["changed"]  # one hour is no new level
    assert got["short"]["p_value"] is None and got["constant"]["p_value"] is None and "still" not in got


def test_hourly_changes_of_latency_and_errors(spark):
    rng = np.random.default_rng(8)
    views, errors = [], []
    for h in range(96):
        at = f"2025-01-0{1 + h // 24}T{h % 24:02d}:10:00Z"
        for i in range(4):
            views.append(view(f"c{h}-{i}", "payment", 2, at, int(rng.normal(300 + 200 * (h >= 60), 20)), date=dt.date(2025, 1, 1 + h // 24)))
            views.append(view(f"c{h}-{i}", "review", 3, at, int(rng.normal(300, 20)), date=dt.date(2025, 1, 1 + h // 24)))
        errors += [error(f"c{h}-{i}", "payment", at, date=dt.date(2025, 1, 1 + h // 24)) for i in range(int(rng.poisson(5)) + 1)]
    got = {r["series"]: r for r in records(hourly_changes(tables(spark, checkout_step_view=views, form_error=errors)))}
    moved = got["latency: payment"]
    assert moved["changed"] and moved["change_at"] == dt.datetime(2025, 1, 3, 12)
    assert not got["latency: review"]["changed"] and not got["errors: payment"]["changed"]
