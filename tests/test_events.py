"""The definitions that only show on hand-built rows."""

from __future__ import annotations

import datetime as dt

import pytest
from frames import DAY, NEXT, begin, cart, error, one, order, payment, records, tables, view
from pyspark.sql import functions as F

from splitlane.functions.assignment import assign_variant, draw, draw_threshold
from splitlane.operators import diagnostics, marts, metrics, quality, readout, results
from splitlane.sources import sinks
from splitlane.sources.contract import CONTRACT_ENUMS, STEP_NAMES
from splitlane.sources.lake import read_event, read_events, register_views


def test_orders_after_midnight_move_only_on_the_event_day(spark):
    events = tables(
        spark,
        add_to_cart=[cart("a", "2025-01-01T23:50:00Z"), cart("b", "2025-01-01T10:00:00Z", "treatment")],
        order_completed=[order("1", "c1", "a", "2025-01-02T00:05:00Z", date=DAY)],
    )
    by_partition = {r["variant"]: r for r in records(metrics.funnel_summary(events, DAY))}
    by_event = {r["variant"]: r for r in records(metrics.variant_funnel(events, DAY))}
    assert by_partition["control"]["orders"] == 1
    assert by_event["control"]["orders"] == 0
    next_day = metrics.guardrails_daily(
        tables(
            spark,
            payment_attempt=[payment("c1", True, "2025-01-02T00:04:00Z", date=DAY)],
            order_completed=[order("1", "c1", "a", "2025-01-02T00:05:00Z", date=DAY)],
        )
    )
    assert one(next_day)["date"] == NEXT


def test_first_exposure_orders_may_exceed_adders_and_are_flagged(spark):
    events = tables(
        spark,
        add_to_cart=[
            cart("a", "2025-01-01T01:00:00Z"),
            cart("b", "2025-01-01T01:00:00Z"),
            cart("t", "2025-01-01T01:00:00Z", "treatment"),
            cart("c", "2025-01-02T01:00:00Z", date=NEXT),
            cart("u", "2025-01-02T01:00:00Z", "treatment", NEXT),
        ],
        order_completed=[
            order(str(i), f"c{i}", user, "2025-01-02T02:00:00Z", date=NEXT)
            for i, user in enumerate("ab")
        ],
    )
    days = {r["date"]: r for r in records(readout.ccr_summary(events))}
    assert days[NEXT]["control_orders"] == 2 and days[NEXT]["control_adders"] == 1
    assert days[NEXT]["invalid_reason"] == "successes exceed observations"
    assert days[NEXT]["p_value"] is None and days[NEXT]["significant"] is False
    bounded = {(r["date"], r["variant"]): r for r in records(metrics.ccr_same_day(events))}
    assert bounded[(NEXT, "control")]["orders"] == 0


def test_earliest_timestamp_is_by_time_not_by_text(spark):
    events = tables(
        spark,
        add_to_cart=[cart("a", "2025-01-01T00:00:00.5Z"), cart("a", "2025-01-01T00:00:00Z")],
    )
    assert one(marts.experiments(events))["first_exposed_at"] == dt.datetime(2025, 1, 1)


def test_unreadable_timestamps_become_null(spark):
    events = tables(spark, add_to_cart=[cart("a", "yesterday")])
    assert one(events.add_to_cart)["timestamp"] is None


def step_events(spark):
    return tables(
        spark,
        checkout_step_view=[
            view("c1", "address", 0, "2025-01-01T01:00:00Z", 100),
            view("c1", "address", 0, "2025-01-01T01:01:00Z", 201),
            view("c1", "payment", 2, "2025-01-01T01:02:00Z", 300),
            view("c2", "address", 0, "2025-01-01T01:00:00Z", 50),
        ],
        form_error=[
            error("c1", "address", "2025-01-01T01:00:10Z"),
            error("c1", "address", "2025-01-01T01:00:20Z"),
        ],
    )


def test_joined_and_exact_error_counts(spark):
    events = step_events(spark)
    joined = {(r["checkout_id"], r["step_name"]): r for r in records(marts.checkout_steps(events))}
    exact = {
        (r["checkout_id"], r["step_name"]): r for r in records(marts.checkout_steps_exact(events))
    }
    key = ("c1", "address")
    assert joined[key]["error_events"] == 4 and exact[key]["error_events"] == 2
    assert joined[key]["median_latency_ms"] == exact[key]["median_latency_ms"] == 150
    assert joined[("c1", "payment")]["error_events"] == 0
    assert exact[("c2", "address")]["median_latency_ms"] == 50


def test_step_mart_equals_the_raw_join(spark):
    events = step_events(spark)
    views, errors = events.checkout_step_view, events.form_error.select("checkout_id", "step_name", F.lit(1).alias("e"))
    raw = (
        views.join(errors, ["checkout_id", "step_name"], "left")
        .groupBy(*marts.STEP_GRAIN)
        .agg(
            F.min("timestamp").alias("first_seen_at"),
            F.floor(F.median("latency_ms")).cast("int").alias("median_latency_ms"),
            F.count("e").alias("error_events"),
        )
    )
    assert sorted(map(tuple, raw.collect())) == sorted(map(tuple, marts.checkout_steps(events).collect()))


def broken_events(spark):
    return tables(
        spark,
        add_to_cart=[
            cart("a", "2025-01-01T01:00:00Z", None),
            cart("b", "2025-01-01T01:00:00Z", "holdout"),
            cart("c", "2025-01-01T01:00:00Z"),
        ],
        begin_checkout=[
            begin("c", "c1", "2025-01-01T02:00:00Z"),
            begin("c", "c1", "2025-01-01T03:00:00Z"),
        ],
        checkout_step_view=[
            view("c1", "confirm", 4, "2025-01-01T02:30:00Z", 10),
            view("ghost", "address", 0, "2025-01-01T02:30:00Z", 10),
            view(None, "address", 0, "2025-01-01T02:30:00Z", 10),
        ],
        form_error=[error("c1", "address", "2025-01-01T01:00:10Z", code="odd")],
        order_completed=[
            order("1", "c1", "c", "2025-01-01T04:00:00Z"),
            order("2", "ghost", "c", "2025-01-01T04:00:00Z"),
            order("3", None, "c", "2025-01-01T04:00:00Z"),
        ],
    )


def test_enum_violations_count_missing_values(spark):
    events = broken_events(spark)
    found = {(r["table_name"], r["field"], r["value"]) for r in records(quality.enum_violations(events))}
    assert found == {
        ("add_to_cart", "variant", None),
        ("add_to_cart", "variant", "holdout"),
        ("checkout_step_view", "step_name", "confirm"),
    }
    every = {
        (r["table_name"], r["field"], r["value"])
        for r in records(quality.enum_violations(events, CONTRACT_ENUMS))
    }
    assert every - found == {("form_error", "error_code", "odd")}


def test_orphans(spark):
    events = broken_events(spark)
    assert one(quality.orphan_orders(events)) == {"total": 3, "orphans": 2, "passed": False}
    assert one(quality.orphan_steps(events)) == {"total": 3, "orphans": 2, "passed": False}
    sample = [(r["key"], r["detail"]) for r in records(quality.orphan_order_sample(events))]
    assert sample == [(None, "3"), ("ghost", "2")]


def test_steps_before_begin(spark):
    early = records(quality.early_steps(broken_events(spark)))
    assert [r["begin_ts"].hour for r in early] == [3]


def test_quality_report(spark):
    rows = {r["name"]: r for r in records(quality.report(broken_events(spark), aa_mode=True))}
    assert len(rows) == 6
    assert not any(r["passed"] for r in rows.values())
    assert rows["orders reference checkouts"]["message"] == "2 orphaned orders; sample: 2, 3"
    assert rows["timestamp order"]["message"].startswith("1 checkouts start before they begin")


def test_quality_report_survives_a_broken_table(spark):
    events = broken_events(spark)
    crippled = type(events)(
        **{name: df for name, df in events.items() if name != "checkout_step_view"},
        checkout_step_view=events.checkout_step_view.drop("step_name"),
    )
    rows = {r["name"]: r for r in records(quality.report(crippled))}
    assert rows["enum values"]["message"].startswith("error: ")
    assert not rows["enum values"]["passed"]
    assert rows["orders reference checkouts"]["message"] == "2 orphaned orders; sample: 2, 3"


def test_checks_survive_unreadable_files(spark, tmp_path):
    events = broken_events(spark)
    base = str(tmp_path / "lake")
    sinks.write_events(events, base)
    (tmp_path / "lake" / "order_completed" / "date=2025-01-01" / "part-bad.parquet").write_text("no")
    verdicts = {v["name"]: v for v in quality.run_checks(read_events(spark, base), aa_mode=True)}
    assert len(verdicts) == 6
    assert verdicts["orders reference checkouts"]["message"].startswith("error: ")
    assert verdicts["timestamp order"]["message"].startswith("1 checkouts start before")


def test_empty_tables_give_a_verdict(spark):
    rows = {r["name"]: r for r in records(quality.report(tables(spark), aa_mode=True))}
    assert rows["orders reference checkouts"]["passed"]
    assert not rows["randomization balance"]["passed"]
    assert rows["A/A difference"]["message"] == "no carts"


def test_quarantine_splits_and_names_the_field(spark):
    events = broken_events(spark)
    kept, rejected = quality.quarantine(
        events.form_error, {"step_name": STEP_NAMES, "error_code": ("invalid",)}
    )
    assert kept.count() == 0
    assert one(rejected)["broken_field"] == "error_code"


def test_contract_of_every_table(spark):
    events = tables(
        spark,
        form_error=[
            error("c1", "payment", "2025-01-01T01:00:00Z"),
            error("c1", "cart", "2025-01-01T01:00:00Z"),
            error("c1", "payment", "not a time"),
            error(None, "payment", "2025-01-01T01:00:00Z"),
        ],
        payment_attempt=[payment("c1", True, "2025-01-01T01:00:00Z", method="cash")],
    )
    broken = {
        (r["table_name"], r["broken_field"]): r["rows"]
        for r in records(quality.contract_outcomes(events))
    }
    assert broken == {
        ("form_error", "none"): 1,
        ("form_error", "step_name"): 1,
        ("form_error", "timestamp"): 1,
        ("form_error", "checkout_id"): 1,
        ("payment_attempt", "payment_method"): 1,
    }
    missing = {
        (r["table_name"], r["field"]): r["missing"]
        for r in records(quality.required_fields(events))
        if not r["passed"]
    }
    assert missing == {("form_error", "timestamp"): 1, ("form_error", "checkout_id"): 1}
    enums = {(r["table_name"], r["field"]): r for r in records(quality.enum_summary(events))}
    assert len(enums) == 5
    assert enums[("payment_attempt", "payment_method")]["bad_rows"] == 1
    assert enums[("form_error", "error_code")]["passed"]


def test_offsets_are_moved_to_utc(spark):
    texts = {
        "2025-01-02T00:30:00+02:00": dt.datetime(2025, 1, 1, 22, 30),
        "2025-01-01T20:30:00.123456-05:30": dt.datetime(2025, 1, 2, 2, 0, 0, 123456),
        "2025-01-01T20:30:00.5Z": dt.datetime(2025, 1, 1, 20, 30, 0, 500000),
        "2025-01-01T20:30:00": dt.datetime(2025, 1, 1, 20, 30),
        "2025-01-01": dt.datetime(2025, 1, 1),
        "2025-01-01T25:30:00+02:00": None,
    }
    events = tables(spark, add_to_cart=[cart(text, text) for text in texts])
    found = {r["user_id"]: r["timestamp"] for r in records(events.add_to_cart)}
    assert found == texts


def test_one_variant_only(spark):
    events = tables(spark, add_to_cart=[cart("a", "2025-01-01T01:00:00Z")])
    row = one(readout.two_proportion_daily(events))
    assert row["invalid_reason"] == "no observations"
    for decision in records(readout.ship_decision(events)):
        assert decision["decision_by_test"] == "DO NOT SHIP"
        assert decision["decision_by_sign"] == "INCONCLUSIVE"


def decision_events(spark, treated_auth, treated_ms=500, viewed=("control", "treatment")):
    carts, orders, payments, views = [], [], [], []
    for variant, bought in (("control", 100), ("treatment", 180)):
        for i in range(400):
            user = f"{variant}{i}"
            carts.append(cart(user, "2025-01-01T01:00:00Z", variant))
            if i < bought:
                orders.append(order(user, user, user, "2025-01-01T02:00:00Z", variant=variant))
            authorized = variant == "control" or i < treated_auth
            payments.append(payment(user, authorized, "2025-01-01T02:00:00Z", variant))
            if variant in viewed:
                ms = 500 if variant == "control" else treated_ms
                views.append(view(user, "payment", 2, "2025-01-01T01:30:00Z", ms, variant))
    return tables(
        spark,
        add_to_cart=carts,
        order_completed=orders,
        payment_attempt=payments,
        checkout_step_view=views,
    )


def decisions(events):
    return {row["scope"]: row for row in records(readout.ship_decision(events))}


def test_three_decision_rules(spark):
    healthy = decisions(decision_events(spark, 400))
    assert set(healthy) == {"2025-01-01", "total"}
    for row in healthy.values():
        assert {row[f"decision_by_{r}"] for r in ("test", "sign", "plan")} == {"SHIP"}
    breached = decisions(decision_events(spark, 300))["2025-01-01"]
    assert breached["guardrails_failed"] == 1
    assert breached["decision_by_sign"] == "SHIP"
    assert breached["decision_by_test"] == breached["decision_by_plan"] == "DO NOT SHIP"


def test_slow_payments_alone_stop_a_launch(spark):
    for row in decisions(decision_events(spark, 400, treated_ms=651)).values():
        assert row["guardrails_failed"] == 1
        assert row["decision_by_sign"] == "SHIP" and row["decision_by_plan"] == "DO NOT SHIP"
    for row in decisions(decision_events(spark, 400, treated_ms=650)).values():
        assert row["decision_by_plan"] == "SHIP"


def test_a_guardrail_without_data_has_failed(spark):
    for viewed in ((), ("control",)):
        for row in decisions(decision_events(spark, 400, viewed=viewed)).values():
            assert row["guardrails_failed"] == 1 and row["decision_by_plan"] == "DO NOT SHIP"


def test_the_window_counts_a_user_once(spark):
    carts = [
        cart(f"{v}{i}", f"2025-01-0{d.day}T01:00:00Z", v, date=d)
        for v in ("control", "treatment")
        for i in range(30)
        for d in (DAY, NEXT)
    ]
    orders = [
        order(f"o{i}", f"c{i}", f"treatment{i}", "2025-01-02T02:00:00Z", variant="treatment", date=NEXT)
        for i in range(15)
    ]
    rows = decisions(tables(spark, add_to_cart=carts, order_completed=orders))
    assert rows["2025-01-01"]["effect_abs"] == 0.0
    assert rows["2025-01-02"]["effect_abs"] == rows["total"]["effect_abs"] == 0.5


def test_cells_without_every_stage_stay(spark):
    events = tables(
        spark,
        payment_attempt=[payment("c1", True, "2025-01-01T05:00:00Z")],
        order_completed=[order("o1", "c2", "u", "2025-01-02T06:00:00Z", 20.0, "treatment", NEXT)],
    )
    stats = {(r["date"], r["variant"]): r for r in records(metrics.summary_stats(events))}
    assert stats[(DAY, "control")]["missing"] == "first exposures, orders"
    assert stats[(DAY, "control")]["auth_rate"] == 1.0
    assert stats[(NEXT, "treatment")]["missing"] == "first exposures, payments"
    assert stats[(NEXT, "treatment")]["aov"] == 20.0
    steps = {(r["date"], r["variant"]): r for r in records(diagnostics.step_through(events))}
    assert steps[(DAY, "control")]["paid"] == 1 and steps[(DAY, "control")]["adders"] == 0
    assert steps[(NEXT, "treatment")]["ordered"] == 1
    hours = {r["hour"]: r for r in records(diagnostics.traffic_by_hour(events))}
    assert set(hours) == {5} and hours[5]["checkouts"] == 0 and hours[5]["attempts"] == 1


def test_days_that_cannot_be_projected_say_why(spark):
    one_arm = tables(spark, add_to_cart=[cart("u", "2025-01-01T01:00:00Z")])
    row = one(readout.impact_projection(one_arm))
    assert row["annual_revenue"] is None and row["invalid_reason"] == "no observations"


def test_small_lift_ships_only_without_the_size_rule(spark):
    df = spark.createDataFrame(
        [(0.001, 0.01, True), (-0.02, 0.01, True)],
        "effect_abs double, p_value double, guardrails_passed boolean",
    ).withColumns(readout._decision_columns(readout.PLAN))
    small, negative = records(df)
    assert small["decision_by_test"] == "SHIP" and small["decision_by_plan"] == "DO NOT SHIP"
    assert negative["decision_by_test"] == "SHIP" and negative["decision_by_sign"] == "DO NOT SHIP"


def test_assignment_is_md5_parity(spark):
    import hashlib

    users = [f"user_{i}" for i in range(200)]
    df = spark.createDataFrame([(u,) for u in users], "u string")
    for row in df.select("u", assign_variant("u").alias("v")).collect():
        even = int(hashlib.md5(f"{row.u}:experiment_v1".encode()).hexdigest(), 16) % 2 == 0
        assert row.v == ("treatment" if even else "control")


def test_draw_thresholds_accept_the_right_share(spark):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("d"))
    for p in (0.0, 0.1, 0.5, 1.0, 1.7):
        share = df.where(draw(F.col("d"), 1) < draw_threshold(p)).count() / 20_000
        assert share == pytest.approx(min(p, 1), abs=0.01)


def test_lake_reads_by_name_and_fills_absent_columns(spark, tmp_path):
    base = str(tmp_path / "lake")
    spark.createDataFrame(
        [("control", "a", "2025-01-01T01:00:00Z")], "variant string, user_id string, timestamp string"
    ).write.parquet(f"{base}/add_to_cart/date=2025-01-01")
    spark.createDataFrame(
        [("b", "s", "2025-01-02T01:00:00Z", 5.0, 2, "treatment")],
        "user_id string, session_id string, timestamp string, cart_value double,"
        " items_count bigint, variant string",
    ).write.parquet(f"{base}/add_to_cart/date=2025-01-02")
    first, second = records(read_event(spark, base, "add_to_cart").orderBy("date"))
    assert first["user_id"] == "a" and first["cart_value"] is None and first["date"] == DAY
    assert second["cart_value"] == 5.0 and second["variant"] == "treatment"


def test_lake_can_keep_columns_outside_the_contract(spark, tmp_path):
    base = str(tmp_path / "lake")
    for date, columns in ((DAY, "user_id string, device string"), (NEXT, "user_id string, country string")):
        spark.createDataFrame([("a", "x")], columns).write.parquet(f"{base}/begin_checkout/date={date}")
    plain = read_event(spark, base, "begin_checkout")
    kept = read_event(spark, base, "begin_checkout", keep_extra=True)
    assert set(kept.columns) - set(plain.columns) == {"device", "country"}
    first, second = records(kept.orderBy("date"))
    assert (first["device"], first["country"], second["country"]) == ("x", None, "x")
    assert first["date"] == DAY and first["timestamp"] is None


def test_writing_a_day_again_replaces_only_that_day(spark, tmp_path):
    path = str(tmp_path / "carts")
    two_days = tables(
        spark,
        add_to_cart=[cart("a", "2025-01-01T01:00:00Z"), cart("b", "2025-01-02T01:00:00Z", date=NEXT)],
    )
    sinks.write_event(two_days.add_to_cart, f"{path}/add_to_cart")
    again = tables(spark, add_to_cart=[cart("c", "2025-01-02T01:00:00.25Z", date=NEXT)])
    sinks.write_event(again.add_to_cart, f"{path}/add_to_cart")
    sinks.write_event(tables(spark).add_to_cart, f"{path}/add_to_cart")
    users = {r["user_id"]: r["timestamp"] for r in records(read_event(spark, path, "add_to_cart"))}
    assert set(users) == {"a", "c"}
    assert users["c"].microsecond == 250_000


def test_days_prune_partitions_even_through_the_newest_day(spark, tmp_path):
    base = str(tmp_path / "lake")
    days = [dt.date(2025, 1, d) for d in range(1, 11)]
    events = tables(
        spark,
        add_to_cart=[cart("a", f"{d}T01:00:00Z", date=d) for d in days],
        order_completed=[order(str(d), "c", "a", f"{d}T01:00:00Z", date=d) for d in days],
        payment_attempt=[payment("c", True, f"{d}T01:00:00Z", date=d) for d in days],
    )
    sinks.write_events(events, base)
    names = ("add_to_cart", "payment_attempt", "order_completed")
    for name in names[1:]:
        # Reading this day would fail, so the query must not touch it.
        (tmp_path / "lake" / name / "date=2025-01-03" / "part-bad.parquet").write_text("no")
    read = {name: read_event(spark, base, name) for name in names}
    lake = type(events)(**{**dict(events.items()), **read})
    assert one(metrics.guardrails(lake, spill_days=1))["total_attempts"] == 1
    assert one(metrics.guardrails_latest(lake))["auth_rate_pct"] == 100
    with pytest.raises(Exception, match="part-bad"):
        metrics.guardrails_daily(lake).collect()


def test_views_marts_and_result_files(spark, tmp_path):
    events = step_events(spark)
    register_views(events, prefix="t_")
    assert spark.sql("SELECT count(*) AS n FROM t_checkout_step_view").first().n == 4
    sinks.save_mart(marts.checkout_steps(events), "fct_checkout_steps", "checkout_id", 4)
    assert spark.table("fct_checkout_steps").count() == 3
    result = spark.createDataFrame([("a", 1.5, None), ("b", None, 2)], "k string, x double, n bigint")
    schema = "k string, x double, n bigint"
    sinks.write_csv(result, str(tmp_path / "csv"))
    sinks.write_json(result, str(tmp_path / "json"))
    for back in (
        sinks.read_csv(spark, str(tmp_path / "csv"), schema),
        sinks.read_json(spark, str(tmp_path / "json"), schema),
    ):
        assert sorted(map(tuple, back.collect())) == [("a", 1.5, None), ("b", None, 2)]


def test_result_files_and_mart_tables_of_a_run(spark, tmp_path):
    events = decision_events(spark, 400)
    folder = str(tmp_path / "results")
    results.save_results(events, folder, dt.datetime(2025, 1, 3), "abc", 42)
    stored = one(sinks.read_json(spark, f"{folder}/ccr_summary", results.CCR_RECORD))
    assert stored["treatment"] == {"adders": 400, "orders": 180, "ccr": 0.45}
    assert stored["significant"] is True
    guard = one(sinks.read_json(spark, f"{folder}/guardrails_summary", results.GUARDRAILS_RECORD))
    assert guard["payment_authorization"]["control"]["authorized"] == 400
    assert guard["average_order_value"]["treatment"] == {"mean": 10.0, "count": 180}
    meta = one(spark.read.json(f"{folder}/_run_meta"))
    assert (meta["date_analyzed"], meta["revision"], meta["seed"]) == ("2025-01-01", "abc", 42)
    funnel = records(sinks.read_csv(spark, f"{folder}/variant_funnel", results.FUNNEL_ROW))
    assert sorted(r["orders"] for r in funnel) == [100, 180]
    spark.sql("CREATE DATABASE IF NOT EXISTS run_marts")
    for _ in range(2):
        results.build_marts(events, "run_marts", buckets=2)
    assert spark.table("run_marts.fct_experiments").count() == 800
    assert spark.table("run_marts.fct_orders").count() == 280


def test_approximate_options(spark):
    events = step_events(spark)
    approx = {(r["checkout_id"], r["step_name"]): r for r in records(marts.checkout_steps(events, 1000))}
    assert approx[("c1", "address")]["error_events"] == 4
    assert approx[("c1", "payment")]["median_latency_ms"] == 300
    users = tables(spark, add_to_cart=[cart(str(i), "2025-01-01T01:00:00Z") for i in range(50)])
    assert one(metrics.exposure_overview(users, rsd=0.01))["total_users"] == pytest.approx(50, abs=2)


def test_pretty_printed_json_reads_as_one_document(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n  "k": "a",\n  "n": 3\n}\n')
    back = sinks.read_json(spark, str(tmp_path / "one.json"), "k string, n bigint", multi_line=True)
    assert one(back) == {"k": "a", "n": 3}


def test_shared_folder_follows_the_session(spark):
    folder = sinks.shared_folder(spark, "x")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert folder != sinks.shared_folder(spark, "x")


def test_runs_of_breach_days(spark):
    carts, orders = [], []
    for d in range(1, 8):
        date = dt.date(2025, 1, d)
        for variant in ("control", "treatment"):
            for i in range(10):
                user = f"{variant}{i}"
                carts.append(cart(user, f"{date}T01:00:00Z", variant, date))
                worse = d in (2, 4, 5, 6)
                bought = 5 if variant == "control" or not worse else 3
                if i < bought:
                    orders.append(
                        order(f"{user}{d}", user, user, f"{date}T02:00:00Z", variant=variant, date=date)
                    )
    events = tables(spark, add_to_cart=carts, order_completed=orders)
    rows = {r["date"].day: r for r in records(diagnostics.rollback_monitor(events))}
    assert [rows[d]["breach_days"] for d in range(1, 8)] == [0, 1, 0, 1, 2, 3, 0]
    assert [d for d in rows if rows[d]["rollback"]] == [6]


def test_sessions_convert_with_their_users_day(spark):
    events = tables(
        spark,
        add_to_cart=[
            cart("a", "2025-01-01T01:00:00Z", session="s1"),
            cart("a", "2025-01-01T05:00:00Z", session="s2"),
            cart("b", "2025-01-01T05:00:00Z", session="s3"),
        ],
        order_completed=[order("1", "c", "a", "2025-01-01T06:00:00Z")],
    )
    row = one(diagnostics.gross_conversion(events))
    assert (row["sessions"], row["converted_sessions"]) == (3, 2)


def test_event_days_keep_rows_whatever_their_partition(spark):
    events = tables(
        spark,
        add_to_cart=[cart("a", "2025-01-01T10:00:00Z")],
        payment_attempt=[
            payment("c1", True, "2025-01-01T11:00:00Z", date=NEXT),
            payment("c2", True, "2025-01-01T12:00:00Z", date=dt.date(2024, 12, 28)),
        ],
        order_completed=[order("1", "c1", "a", "2025-01-01T11:01:00Z", date=NEXT)],
    )
    assert one(metrics.guardrails(events, DAY))["total_attempts"] == 2


def test_rounding_is_right_at_any_size(spark):
    from splitlane.functions.formatting import settled

    values = [5_000_000.123456, 3.2e12, 0.0000005, -0.0000005, 1.0000004, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(settled(F.col("x"), 6)).collect()]
    assert got == [5_000_000.123456, 3.2e12, 0.000001, -0.000001, 1.0, None]


def test_poisson_weights_are_not_cut_off(spark):
    from splitlane.operators.resampling import POISSON_ONE

    assert (1 - POISSON_ONE[-1]) * 2**32 < 1
    assert abs(POISSON_ONE[7] - 0.9999897508033253) < 1e-15


def test_one_armed_metrics_can_be_refused(spark):
    both = [cart("a", "2025-01-01T01:00:00Z"), cart("b", "2025-01-01T01:00:00Z", "treatment")]
    later = [cart("a", "2025-01-02T01:00:00Z", date=NEXT)]
    cells = metrics.ccr_same_day(tables(spark, add_to_cart=both))
    assert sorted(records(metrics.require_both_variants(cells)), key=str) == sorted(
        records(cells), key=str
    )
    daily = metrics.ccr_same_day(tables(spark, add_to_cart=both + later))
    assert len(records(metrics.require_both_variants(daily))) == 3
    with pytest.raises(Exception, match="lacks a variant"):
        metrics.require_both_variants(daily, ["date"]).collect()
