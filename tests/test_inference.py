from __future__ import annotations

import math

import pytest
from frames import one, records
from pyspark.sql import functions as F

from splitlane.functions import normal
from splitlane.functions.formatting import money, percent, pretty_round, signed_pp
from splitlane.functions.inference import mean_ci, proportion_ci, two_proportion_test
from splitlane.operators.guardrails import evaluate, read_rule


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "s_a bigint, n_a bigint, s_b bigint, n_b bigint")


def run_test(df, **kwargs):
    return two_proportion_test(df, "s_a", "n_a", "s_b", "n_b", **kwargs)


def test_published_conversion_test(spark):
    row = one(run_test(pairs(spark, (1860, 5045, 1871, 4955))))
    expected = {
        "effect_abs": 0.008916522238301305,
        "effect_rel": 0.024184868114102195,
        "ci_low": -0.010042497009491346,
        "ci_high": 0.027875541486093957,
        "p_value": 0.3566335181234219,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-14), name
    assert row["invalid_reason"] is None


def test_published_proportion_intervals(spark):
    df = spark.createDataFrame([(1860, 2027), (1872, 2015)], "s bigint, n bigint")
    first, second = records(proportion_ci(df, "s", "n").orderBy("s"))
    assert first["rate"] == pytest.approx(0.9176122, abs=1e-7)
    assert first["ci_low"] == pytest.approx(0.9056423, abs=1e-7)
    assert second["ci_high"] == pytest.approx(0.9402438, abs=1e-7)


def test_tail_matches_erf(spark):
    grid = [i / 50 for i in range(-400, 401)]
    df = spark.createDataFrame([(z,) for z in grid], "z double")
    for row in df.select("z", normal.normal_cdf(F.col("z")).alias("p")).collect():
        assert row.p == pytest.approx(0.5 * (1 + math.erf(row.z / math.sqrt(2))), abs=1e-15)


def test_far_tail_stays_positive_then_zero(spark):
    df = spark.createDataFrame([(8.0,), (20.0,), (40.0,)], "z double")
    near, far, beyond = (r.p for r in df.select(normal.two_sided_p(F.col("z")).alias("p")).collect())
    assert near == pytest.approx(math.erfc(8 / math.sqrt(2)), rel=1e-9)
    assert 0 < far < 1e-80
    assert beyond == 0


def test_critical_values(spark):
    assert normal.critical_value(0.05) == 1.96
    assert normal.critical_value(0.01) == 2.576
    assert normal.critical_value(0.1) == pytest.approx(1.6449, abs=5e-4)
    alphas = [0.05, 0.01, 0.1, 0.2, 0.001]
    df = spark.createDataFrame([(a,) for a in alphas], "alpha double")
    shown = df.select("alpha", normal.critical_value_of(F.col("alpha")).alias("z"))
    for row in shown.collect():
        assert row.z == pytest.approx(normal.critical_value(row.alpha), abs=1e-12)
    with pytest.raises(ValueError):
        normal.critical_value(1.0)


def test_untestable_counts_keep_a_reason(spark):
    df = pairs(
        spark,
        (0, 0, 1, 2),
        (5, 4, 1, 2),
        (-1, 4, 1, 2),
        (None, None, 1, 2),
    )
    rows = records(run_test(df))
    assert {r["invalid_reason"] for r in rows} == {
        "no observations",
        "successes exceed observations",
        "negative successes",
        "missing counts",
    }
    for row in rows:
        assert row["p_value"] is None and row["effect_rel"] is None and row["ci_low"] is None


def test_extreme_but_valid_counts(spark):
    none, everyone, from_zero = records(
        run_test(pairs(spark, (0, 10, 0, 10), (10, 10, 10, 10), (0, 10, 5, 10)))
    )
    assert none["p_value"] == 1 and none["effect_rel"] == math.inf
    assert everyone["p_value"] == 1 and everyone["effect_rel"] == 0
    assert from_zero["effect_rel"] == math.inf and from_zero["p_value"] < 0.05


def test_strict_mode_fails_the_job(spark):
    with pytest.raises(Exception, match="successes exceed observations"):
        run_test(pairs(spark, (5, 4, 1, 2)), strict=True).collect()
    assert one(run_test(pairs(spark, (1, 4, 1, 4)), strict=True))["p_value"] == 1


def test_proportion_interval_is_clipped(spark):
    df = spark.createDataFrame([(0, 5), (1, 20), (19, 20), (1, 0)], "s bigint, n bigint")
    rows = records(proportion_ci(df, "s", "n"))
    assert rows[0]["ci_low"] == 0 and rows[1]["ci_low"] == 0
    assert rows[2]["ci_high"] == 1
    assert rows[3]["rate"] is None and rows[3]["ci_low"] is None


def test_mean_interval(spark):
    values = [250, 260, 255, 248, 262]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0)], "g string, v double")
    many, single = records(mean_ci(df, ["g"], "v").orderBy("g"))
    mean = sum(values) / 5
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / 4)
    assert many["mean"] == pytest.approx(mean)
    assert many["ci_high"] == pytest.approx(mean + 1.96 * std / math.sqrt(5))
    assert single["ci_low"] is None and single["mean"] == 1


def test_rounding_follows_magnitude(spark):
    cases = {1234.5678: 1234.6, 12.345678: 12.35, 0.350123: 0.35, 0.001234: 0.0012, -250.06: -250.1}
    df = spark.createDataFrame([(v,) for v in cases], "v double")
    for row in df.select("v", pretty_round(F.col("v")).alias("r")).collect():
        assert row.r == cases[row.v]


def test_labels(spark):
    df = spark.createDataFrame([(0.0089, 0.9176, 256.8235), (None, None, None)], "e double, r double, m double")
    shown = df.select(signed_pp(F.col("e")), percent(F.col("r")), money(F.col("m"))).collect()
    assert tuple(shown[0]) == ("+0.89pp", "91.8%", "$256.82")
    assert tuple(shown[1]) == (None, None, None)


@pytest.mark.parametrize(
    ("base", "treated", "rule", "passed"),
    [
        (92.0, 91.75, {"max_drop_pp": 0.25}, True),
        (92.0, 91.5, {"max_drop_pp": 0.25}, False),
        (200.0, 198.0, {"max_drop_pct": 1.0}, True),
        (200.0, 197.0, {"max_drop_pct": 1.0}, False),
        (1000.0, 1150.0, {"max_increase_ms": 150}, True),
        (1000.0, 1151.0, {"max_increase_ms": 150}, False),
        (1.0, 1.5, {"max_increase_pp": 0.25}, False),
        (100.0, 101.0, {"max_increase_pct": 1.0}, True),
        (0.0, 1.0, {"max_drop_pct": 1.0}, False),
        (0.0, 1.0, {"max_increase_pct": 1000.0}, False),
        (0.5, 0.9, {"max_drop_pct": 1.0}, True),
        (None, 1.0, {"max_drop_pp": 1.0}, False),
    ],
)
def test_guardrail_rules(spark, base, treated, rule, passed):
    metrics = spark.createDataFrame(
        [("m", base, treated)], "metric string, baseline double, treatment double"
    )
    row = one(evaluate(metrics, {"m": rule}))
    assert row["passed"] is passed
    assert row["message"].endswith("pass" if passed else "fail")


def test_last_known_rule_key_wins():
    assert read_rule({"max_drop_pp": 1, "note": 3, "max_increase_ms": 9}) == ("max_increase_ms", 9.0)
    with pytest.raises(ValueError):
        read_rule({"limit": 1})
