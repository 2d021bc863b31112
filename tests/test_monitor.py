from __future__ import annotations

import datetime as dt

from frames import order, payment, records, tables
from pyspark.sql import functions as F

from splitlane.operators.metrics import guardrails_daily
from splitlane.streaming.monitor import STORE_SETTING, accounted, outcome_stream, run_monitor


def feed(spark, folder, name, events):
    """Write outcomes as one file of a stream's source folder."""
    (
        outcome_stream(events)
        .coalesce(1)
        .write.mode("append")
        .parquet(str(folder))
    )


def drain(spark, folder, out):
    schema = spark.read.parquet(str(folder)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    run_monitor(stream, str(out), str(out / "checkpoint"))
    days = spark.read.parquet(str(out / "days")).drop("batch")
    return {(r["date"], r["variant"]): r for r in records(days)}


def test_days_close_once_and_late_or_repeated_rows_do_not_count(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    first = tables(
        spark,
        payment_attempt=[
            payment("c1", True, "2025-01-01T10:00:00Z"),
            payment("c1", True, "2025-01-01T10:00:00Z"),
            payment("c2", False, "2025-01-01T11:00:00Z", "treatment"),
        ],
        order_completed=[order("1", "c1", "u", "2025-01-01T10:01:00Z", 30.0)],
    )
    feed(spark, source, "1", first)
    drain_first = tables(
        spark, payment_attempt=[payment("c9", True, "2025-01-02T10:00:00Z")]
    )
    feed(spark, source, "2", drain_first)
    closed = drain(spark, source, out)
    day = dt.date(2025, 1, 1)
    assert closed[(day, "control")]["total_attempts"] == 1
    assert closed[(day, "control")]["order_value"] == 30.0
    assert closed[(day, "treatment")]["authorized"] == 0
    assert (dt.date(2025, 1, 2), "control") not in closed

    late = tables(
        spark,
        payment_attempt=[
            payment("late", True, "2025-01-01T12:00:00Z"),
            payment("c10", True, "2025-01-03T10:00:00Z"),
        ],
    )
    feed(spark, source, "3", late)
    later = drain(spark, source, out)
    assert later[(day, "control")]["total_attempts"] == 1
    assert later[(dt.date(2025, 1, 2), "control")]["total_attempts"] == 1

    verdicts = spark.read.parquet(str(out / "verdicts")).where(F.col("date") == day)
    found = {r["metric"]: r["passed"] for r in records(verdicts)}
    assert found == {"payment_auth_rate": False, "aov": False}


def test_a_final_run_closes_every_day_and_equals_the_batch_guardrails(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    events = tables(
        spark,
        payment_attempt=[
            payment("c1", True, "2025-01-01T10:00:00Z"),
            payment("c1", False, "2025-01-01T10:00:00Z"),
            payment("c2", True, "2025-01-02T23:59:59Z", "treatment"),
            payment(None, True, "2025-01-03T00:00:00Z"),
        ],
        order_completed=[order("1", "c1", "u", "2025-01-01T10:01:00Z", 30.0)],
    )
    feed(spark, source, "1", events)
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    run_monitor(stream, str(out), str(out / "checkpoint"), final=True)
    days = spark.read.parquet(str(out / "days")).drop("batch")
    found = {
        (r["date"], r["variant"]): (r["total_attempts"], r["authorized"], r["order_count"])
        for r in records(days)
    }
    expected = {
        (r["date"], r["variant"]): (r["total_attempts"], r["authorized"], r["order_count"] or 0)
        for r in records(guardrails_daily(events))
    }
    assert found == expected and len(found) == 3


def accounts(spark, out):
    return {(r["date"], r["variant"]): r for r in records(accounted(spark, str(out)))}


def test_every_row_sent_is_counted_repeated_late_or_pending(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    one, two, three = (dt.date(2025, 1, d) for d in (1, 2, 3))
    again = payment("c1", True, "2025-01-01T10:00:00Z")
    batches = [
        {
            "payment_attempt": [again, again, payment("c2", False, "2025-01-01T11:00:00Z", "treatment")],
            "order_completed": [order("1", "c1", "u", "2025-01-01T10:01:00Z", 30.0), order("1", "c1", "u", "2025-01-01T10:05:00Z", 31.0)],
        },
        # Far behind the newest row, but its day is still open: in time.
        {"payment_attempt": [payment("c3", True, "2025-01-01T23:30:00Z"), payment("c4", True, "2025-01-01T02:00:00Z"), again]},
        {"payment_attempt": [payment("c5", True, "2025-01-02T10:00:00Z")]},
        {"payment_attempt": [payment("late", True, "2025-01-01T12:00:00Z"), again, payment("c6", True, "2025-01-03T10:00:00Z")]},
        {"payment_attempt": [payment("alone", True, "2025-01-01T12:00:00Z", "holdout"), payment("c7", True, "2025-01-03T11:00:00Z")]},
    ]
    sent = 0
    for number, batch in enumerate(batches):
        feed(spark, source, str(number), tables(spark, **batch))
        sent += sum(map(len, batch.values()))
        if number in (0, 3):  # two files come in one run, batch by batch
            continue
        drain(spark, source, out)
        found = accounts(spark, out).values()
        columns = ("counted", "repeated", "late", "pending", "undated")
        assert all(r["rows_sent"] == sum(r[c] for c in columns) for r in found)
        assert sum(r["rows_sent"] for r in found) == sent
    rows = accounts(spark, out)

    def parts(date, variant):
        r = rows[(date, variant)]
        return r["counted"], r["repeated"], r["late"], r["pending"]

    assert parts(one, "control") == (4, 3, 2, 0)
    assert parts(one, "treatment") == (1, 0, 0, 0)
    assert parts(one, "holdout") == (0, 0, 1, 0)  # nothing of it came in time
    assert parts(two, "control") == (1, 0, 0, 0)
    assert parts(three, "control") == (0, 0, 0, 2)
    days = {(r["date"], r["variant"]): r for r in records(spark.read.parquet(str(out / "days")))}
    assert days[(one, "control")]["order_value"] == 30.0  # the earliest of the repeated order


def test_orders_without_an_id_are_told_apart_and_rows_without_a_time_are_kept_count_of(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    orders = [order(None, f"c{i}", "u", "2025-01-01T10:00:00Z", float(i)) for i in range(5)]
    events = tables(
        spark,
        payment_attempt=[payment("c1", True, None)],
        order_completed=[*orders, orders[0]],
    )
    feed(spark, source, "1", events)
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    before = spark.conf.get(STORE_SETTING)
    run_monitor(stream, str(out), str(out / "checkpoint"), final=True)
    assert spark.conf.get(STORE_SETTING) == before
    rows = accounts(spark, out)
    day = rows[(dt.date(2025, 1, 1), "control")]
    assert (day["counted"], day["repeated"], day["late"]) == (5, 1, 0)
    undated = rows[(None, "control")]
    assert (undated["rows_sent"], undated["undated"]) == (1, 1)
