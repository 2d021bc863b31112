"""Frequent sequences against a count of all subsequences."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from frames import error, records, tables
from pyspark.sql import functions as F

from splitlane.operators.sequences import error_patterns, frequent_sequences

ROW = "id string, t long, item string, variant string"


def brute(rows, least, longest):
    by = {}
    for s, t, item, v in rows:
        if s is not None and t is not None and item is not None:
            by.setdefault(s, []).append((t, item))
    counts = {}
    for items in by.values():
        names = [item for _, item in sorted(items)]
        for pattern in {p for k in range(1, longest + 1) for p in combinations(names, k)}:
            counts[pattern] = counts.get(pattern, 0) + 1
    least = least if least >= 1 else max(1, -(-len(by) * least // 1))
    return {p: n for p, n in counts.items() if n >= least}


@pytest.mark.parametrize(("least", "longest"), [(1, 3), (6, 4), (0.3, 2), (10**6, 3)])
def test_patterns_equal_all_subsequences(spark, least, longest):
    rng = random.Random(11)
    rows = []
    for s in range(25):
        for _ in range(rng.randint(1, 9)):
            rows.append((f"s{s}", rng.randint(0, 4), rng.choice("abc"), "control" if s % 2 else "treatment"))
    rows += [("s0", 1, "a", "treatment")] * 3  # one item several times at one moment
    rows += [("hot", i % 20, "abc"[i % 3], "control") for i in range(45)]
    rows += [(None, 1, "a", "control"), ("s1", None, "a", "control"), ("s1", 1, None, "control")]
    df = spark.createDataFrame(rows, ROW)
    got = records(frequent_sequences(df, "id", F.col("t"), F.col("item"), least, longest))
    assert {tuple(r["pattern"]): r["support"] for r in got} == brute(rows, least, longest)
    assert all(r["support"] == r["control_support"] + r["treatment_support"] for r in got)
    assert all(r["length"] == len(r["pattern"]) for r in got)


def test_error_patterns_name_steps_codes_and_repeats(spark):
    at = "2025-01-01T10:0{}:00Z"
    rows = [
        error("c1", "payment", at.format(1), "declined"),
        error("c1", "payment", at.format(2), "declined"),
        error("c1", "review", at.format(3), "timeout"),
        error("c2", "payment", at.format(1), "declined", variant="treatment"),
        error("c2", "review", at.format(0), "timeout", variant="treatment"),
    ]
    got = {r["pattern"]: r for r in records(error_patterns(tables(spark, form_error=rows), 1))}
    twice = got["payment/declined > payment/declined"]
    assert (twice["support"], twice["repeats"], twice["share"]) == (1, True, 0.5)
    assert got["payment/declined"]["support"] == 2 and got["payment/declined"]["treatment_support"] == 1
    assert "review/timeout > payment/declined" in got
    assert "payment/declined > payment/declined > review/timeout" in got and len(got) == 6
    assert records(error_patterns(tables(spark))) == []
    with pytest.raises(ValueError, match="at least one"):
        frequent_sequences(tables(spark).form_error, "checkout_id", F.col("timestamp"), F.col("error_code"), 0)
