"""Every named query: equal to its SQL, and a plan fit for large tables."""

from __future__ import annotations

import re

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from splitlane.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
NAMES = list(QUERIES)  # optional parts have tests of their own
# These write files or run a stream before they return their plan.
EAGER = {
    "sink_roundtrip",
    "mart_tables",
    "funnel_csv_roundtrip",
    "ccr_json_roundtrip",
    "guardrails_json_roundtrip",
    "monitor_stream",
    "monitor_accounts",
    "monitor_verdicts",
    "sketch_rollup",
    "error_patterns",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    difference, _ = compare(spark, duck, queries()[name], oracle_sql()[name], SMALL)
    assert difference is None


@pytest.mark.parametrize("name", [n for n in NAMES if n not in EAGER])
def test_plan_has_no_pairwise_join_and_no_python(spark, name):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(
        r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEval|BatchEval|InPandas|Scan ExistingRDD",
        plan,
    )


def test_scans_read_only_the_needed_columns(spark):
    plan = queries()["event_counts_by_date"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("value" not in s for s in schemas)
    assert "EqualTo(event_type,view)" in plan


def test_entry_is_the_flagship(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and "p_value" in rows[0].asDict()


def test_newest_day_counts(spark):
    rows = {r.variant: r for r in queries()["aa_counts"](spark, MEDIUM).collect()}
    assert (rows["control"].orderers, rows["control"].adders) == (8, 28)
    assert (rows["treatment"].orderers, rows["treatment"].adders) == (8, 33)


def test_known_violations(spark):
    run = queries()
    assert run["dq_orphan_orders"](spark, MEDIUM).first().orphans == 1135
    assert run["dq_orphan_steps"](spark, MEDIUM).first().orphans == 1296
    assert run["dq_timestamp_order"](spark, MEDIUM).first().violations == 293


def test_bounded_orders_never_exceed_adders_and_shares_sum_up(spark):
    run = queries()
    cells = run["ccr_same_day"](spark, MEDIUM).collect()
    assert cells and all(0 <= r.orders <= r.adders for r in cells)
    shares = run["variant_balance"](spark, MEDIUM).collect()
    assert sum(r.percentage for r in shares) == pytest.approx(100, abs=0.02)
