"""Cut lookups give what plain windows give."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from frames import cart, error, order, records, tables, view
from pyspark.sql import Window
from pyspark.sql import functions as F

from splitlane.operators import diagnostics
from splitlane.operators.skew import exact_percentiles, with_neighbour
from splitlane.sources.lake import read_events
from splitlane.sources.sinks import write_events


def clicks(spark, seed=7):
    """One key owns a third of the rows; some rows lack a key."""
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rng.choice([None, "a", "b", *map(str, range(200))])
        minute = rng.randrange(0, 60 * 30)
        at = f"2025-01-{1 + minute // 1440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:{rng.randrange(60):02d}"
        rows.append((key, at, i, rng.randrange(5)))
    df = spark.createDataFrame(rows, "k string, at string, id int, v int")
    return df.withColumn("at", F.col("at").cast("timestamp_ntz"))


@pytest.mark.parametrize("ahead", [False, True])
def test_rows_without_time_sort_first_and_rows_without_key_stay_alone(spark, ahead):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", "2025-01-01 00:00:00", 2), ("a", "2025-01-01 00:05:00", 3),
         (None, "2025-01-01 00:00:00", 4), (None, "2025-01-01 00:01:00", 5)],
        "k string, at string, id int",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    out = with_neighbour(df, "k", "at", ["id"], ["id"], "n", ahead)
    near = {r.id: r.n.id if r.n else None for r in out.collect()}
    expected = {1: 2, 2: 3, 3: None} if ahead else {1: None, 2: 1, 3: 2}
    assert near == {**expected, 4: None, 5: None}


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("crowded", [False, True])
def test_neighbours_match_a_plain_window(spark, ahead, crowded):
    df = clicks(spark)
    if crowded:  # a third of all rows in one minute of one key, some without a time
        at = F.lit("2025-01-01 00:07:00").cast("timestamp_ntz") + F.make_dt_interval(
            secs=F.col("id") % 60
        )
        hot = F.when(F.col("k") == "hot", at).otherwise(F.col("at"))
        df = df.withColumn("at", F.when(F.col("id") % 17 != 0, hot))
    window = Window.partitionBy("k").orderBy("at", "id")
    look = F.lead if ahead else F.lag
    plain = df.withColumn("n", look(F.struct("v", "id")).over(window))
    cut = with_neighbour(df, "k", "at", ["id"], ["v", "id"], "n", ahead)
    # Rows without a key are nobody's neighbours' business but must survive.
    assert cut.count() == df.count()
    keyed = F.col("k").isNotNull()
    assert sorted(map(tuple, cut.where(keyed).select("id", "n").collect())) == sorted(
        map(tuple, plain.where(keyed).select("id", "n").collect())
    )


def test_percentiles_from_the_histogram(spark):
    df = clicks(spark).where(F.col("k").isNotNull())
    ours = exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9})
    plain = df.groupBy("k").agg(
        F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.9)).alias("p90")
    )
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_sequences_and_backtracks_survive_a_heavy_checkout(spark):
    rng = random.Random(3)
    steps = ["address", "shipping", "payment", "review"]
    views, errors, seen, failed = [], [], {}, {}
    for i in range(400):
        checkout = "hot" if i % 2 else f"c{i % 40}"
        at = f"2025-01-01T{rng.randrange(24):02d}:{rng.randrange(60):02d}:{i % 60:02d}Z"
        step, code = rng.randrange(4), rng.choice(["invalid", "timeout"])
        views.append(view(checkout, steps[step], step, at, 100 + i))
        errors.append(error(checkout, steps[step], at, code, f"f{i % 5}"))
        seen.setdefault(checkout, []).append((at, step, 100 + i))
        failed.setdefault(checkout, []).append((at, steps[step], f"f{i % 5}", code))
    events = tables(spark, checkout_step_view=views, form_error=errors)
    pairs = [p for rows in map(sorted, seen.values()) for p in zip(rows, rows[1:])]
    (row,) = records(diagnostics.step_backtracks(events))
    assert row["views"] == 400
    assert row["backtracks"] == sum(b[1] < a[1] for a, b in pairs)
    assert row["revisits"] == sum(b[1] == a[1] for a, b in pairs)
    timed = records(diagnostics.time_in_step(events))
    assert sum(r["transitions"] for r in timed) == len(pairs)
    follow = Counter(
        (f"{a[1]}:{a[3]}", f"{b[1]}:{b[3]}")
        for rows in map(sorted, failed.values())
        for a, b in zip(rows, rows[1:])
    )
    found = {
        (r["previous_error"], r["error"]): r["times"]
        for r in records(diagnostics.error_sequences(events))
    }
    assert found == follow


@pytest.mark.parametrize("name", ["error_sequences", "step_backtracks", "time_in_step"])
def test_a_lookup_reads_its_input_twice(spark, name, tmp_path):
    view_rows = [view("c", "payment", 2, "2025-01-01T01:00:00Z", 100)]
    error_rows = [error("c", "payment", "2025-01-01T01:00:00Z")]
    events = tables(spark, checkout_step_view=view_rows, form_error=error_rows)
    write_events(events, str(tmp_path))
    plan = getattr(diagnostics, name)(read_events(spark, str(tmp_path)))
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert text.count("FileScan") <= 2


def test_sessions_without_a_user_count(spark):
    events = tables(
        spark,
        add_to_cart=[
            cart("u", "2025-01-01T01:00:00Z", session="s1"),
            cart(None, "2025-01-01T01:00:00Z", session="s2"),
        ],
        order_completed=[
            order("o", "c", "u", "2025-01-01T02:00:00Z"),
            order("p", "c", None, "2025-01-01T02:00:00Z"),
        ],
    )
    (row,) = records(diagnostics.gross_conversion(events))
    assert (row["sessions"], row["converted_sessions"]) == (2, 1)
