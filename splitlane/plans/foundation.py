"""Sources, marts and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.operators import marts, metrics, quality, readout, results
from splitlane.operators.dates import most_recent_date
from splitlane.plans.common import (
    EXPERIMENTS,
    NEWEST,
    SAME_DAY,
    TEST_OUTPUT,
    Query,
    day,
    moment,
    on_events,
    presentable,
    r,
    tested,
    wide,
    with_tables,
)
from splitlane.sources import sinks
from splitlane.sources.activity_log import read_activity_log
from splitlane.sources.contract import (
    CONTRACT_ENUMS,
    EVENT_NAMES,
    STEP_NAMES,
    VARIANTS,
    EventTables,
)
from splitlane.sources.lake import read_events, register_views


def scan_summary(events: EventTables) -> DataFrame:
    """Rows, days and time range of every event table."""
    out = None
    for name, df in events.items():
        part = df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("date").alias("days"),
            F.min("timestamp").alias("first_at"),
            F.max("timestamp").alias("last_at"),
        ).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


SCAN_SQL = with_tables(
    select=" UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows, count(DISTINCT date) AS days, "
        f"{moment('min(timestamp)', 'first_at')}, {moment('max(timestamp)', 'last_at')} "
        f"FROM {name}"
        for name in EVENT_NAMES
    )
)


def lake_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all tables as a date-partitioned lake, read it back, and summarize it."""
    base = sinks.shared_folder(spark, "lake")
    sinks.write_events(read_activity_log(spark, sf_dir), base)
    return presentable(scan_summary(read_events(spark, base)))


def views_through_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event views queried by name."""
    register_views(read_activity_log(spark, sf_dir), prefix="splitlane_")
    return presentable(
        spark.sql(
            "SELECT date, variant, count(*) AS orders, avg(order_value) AS aov"
            " FROM splitlane_order_completed GROUP BY date, variant"
        )
    )


def mart_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialize the three marts in the shared folder, and summarize them as stored."""
    path = sinks.shared_folder(spark, "marts")
    database = f"splitlane_{path.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    results.build_marts(read_activity_log(spark, sf_dir), database, buckets)
    out = None
    for name, key, moment_of in (
        ("fct_experiments", "user_id", "first_exposed_at"),
        ("fct_checkout_steps", "checkout_id", "first_seen_at"),
        ("fct_orders", "checkout_id", "ordered_at"),
    ):
        part = (
            spark.table(f"{database}.{name}")
            .groupBy("variant")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.count_distinct(key).alias("keys"),
                F.min(moment_of).alias("first_at"),
                F.max(moment_of).alias("last_at"),
            )
            .select(F.lit(name).alias("mart"), "*")
        )
        out = part if out is None else out.unionByName(part)
    return presentable(out)


def funnel_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.shared_folder(spark, "funnel-csv")
    sinks.write_csv(metrics.variant_funnel(read_activity_log(spark, sf_dir)), path)
    return presentable(sinks.read_csv(spark, path, results.FUNNEL_ROW))


def ccr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.shared_folder(spark, "ccr-json")
    sinks.write_json(results.ccr_records(read_activity_log(spark, sf_dir)), path)
    stored = sinks.read_json(spark, path, results.CCR_RECORD)
    arms = [
        F.col(f"{v}.{name}").alias(f"{v}_{name}")
        for v in VARIANTS
        for name in ("adders", "orders", "ccr")
    ]
    return presentable(stored.select("*", *arms).drop(*VARIANTS))


def guardrails_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.shared_folder(spark, "guardrails-json")
    sinks.write_json(results.guardrails_records(read_activity_log(spark, sf_dir)), path)
    stored = sinks.read_json(spark, path, results.GUARDRAILS_RECORD)
    arms = [
        F.struct(
            F.lit(v).alias("variant"),
            F.col(f"payment_authorization.{v}").alias("auth"),
            F.col(f"average_order_value.{v}").alias("value"),
        )
        for v in VARIANTS
    ]
    rows = stored.select("date", F.inline(F.array(*arms))).where(F.col("auth").isNotNull())
    return presentable(
        rows.select(
            "date",
            "variant",
            "auth.*",
            F.col("value.mean").alias("mean_order_value"),
            F.col("value.count").alias("order_count"),
        )
    )


def run_metadata(events: EventTables) -> DataFrame:
    return readout.run_metadata(events, dt.datetime(2024, 1, 31), "local", 42)


STEP_JOIN = """
steps AS (
  SELECT c.checkout_id, c.step_name, c.step_index, c.variant,
    min(c."timestamp") AS first_seen_at,
    CAST(floor(quantile_cont(c.latency_ms, 0.5)) AS BIGINT) AS median_latency_ms,
    count(e.checkout_id) AS error_events
  FROM checkout_step_view c LEFT JOIN form_error e
    ON c.checkout_id = e.checkout_id AND c.step_name = e.step_name
  GROUP BY 1, 2, 3, 4)"""

STEPS_EXACT = """
steps AS (
  SELECT c.*, coalesce(e.errors, 0) AS error_events
  FROM (SELECT checkout_id, step_name, step_index, variant,
          min("timestamp") AS first_seen_at,
          CAST(floor(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS median_latency_ms
        FROM checkout_step_view GROUP BY 1, 2, 3, 4) c
  LEFT JOIN (SELECT checkout_id, step_name, count(*) AS errors
             FROM form_error GROUP BY 1, 2) e
    ON c.checkout_id = e.checkout_id AND c.step_name = e.step_name)"""

STEP_OUTPUT = f"""
SELECT checkout_id, step_name, step_index, variant, {moment('first_seen_at', 'first_seen_at')},
  median_latency_ms, error_events FROM steps"""


def _integrity_sql(child: str) -> str:
    return with_tables(
        select=f"""
SELECT count(*) AS total, count(*) FILTER (WHERE b.checkout_id IS NULL) AS orphans,
  count(*) FILTER (WHERE b.checkout_id IS NULL) = 0 AS passed
FROM {child} c LEFT JOIN (SELECT DISTINCT checkout_id FROM begin_checkout) b
  ON c.checkout_id = b.checkout_id"""
    )


EARLY_STEPS = """
early_steps AS (
  SELECT b.checkout_id, b."timestamp" AS begin_ts, f.first_step_ts
  FROM begin_checkout b
  JOIN (SELECT checkout_id, min("timestamp") AS first_step_ts
        FROM checkout_step_view GROUP BY 1) f ON b.checkout_id = f.checkout_id
  WHERE f.first_step_ts < b."timestamp")"""

SAMPLES = (
    EARLY_STEPS
    + """,
order_sample AS (
  SELECT checkout_id AS key, order_id AS detail FROM order_completed
  WHERE checkout_id NOT IN (SELECT checkout_id FROM begin_checkout)
  ORDER BY 1, 2 LIMIT 10),
step_sample AS (
  SELECT checkout_id AS key, step_name AS detail FROM checkout_step_view
  WHERE checkout_id NOT IN (SELECT checkout_id FROM begin_checkout)
  ORDER BY 1, 2 LIMIT 10),
early_sample AS (
  SELECT checkout_id AS key, CAST(begin_ts AS VARCHAR) AS detail FROM early_steps
  ORDER BY 1, 2 LIMIT 10)"""
)

ENUM_VALUES = {
    ("checkout_step_view", "step_name"): STEP_NAMES,
    ("add_to_cart", "variant"): VARIANTS,
    ("begin_checkout", "variant"): VARIANTS,
    ("checkout_step_view", "variant"): VARIANTS,
    ("order_completed", "variant"): VARIANTS,
}

# The contract of every enum column, stated apart from the operators'.
VARIANT_ENUM = ("control", "treatment")
STEP_ENUM = ("address", "shipping", "payment", "review")
CONTRACT = {
    ("add_to_cart", "variant"): VARIANT_ENUM,
    ("begin_checkout", "variant"): VARIANT_ENUM,
    ("checkout_step_view", "variant"): VARIANT_ENUM,
    ("form_error", "variant"): VARIANT_ENUM,
    ("payment_attempt", "variant"): VARIANT_ENUM,
    ("order_completed", "variant"): VARIANT_ENUM,
    ("checkout_step_view", "step_name"): STEP_ENUM,
    ("form_error", "step_name"): STEP_ENUM,
    ("form_error", "error_code"): ("invalid", "declined", "timeout"),
    ("payment_attempt", "payment_method"): ("card", "paypal"),
}
FIELDS = {
    "add_to_cart": "user_id session_id timestamp cart_value items_count variant date",
    "begin_checkout": "user_id checkout_id timestamp variant date",
    "checkout_step_view": "checkout_id step_name step_index timestamp variant latency_ms date",
    "form_error": "checkout_id step_name field_name error_code timestamp variant date",
    "payment_attempt": "checkout_id payment_method authorized timestamp variant date",
    "order_completed": "order_id checkout_id user_id timestamp order_value currency variant date",
}

REQUIRED_SQL = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{field}' AS field, count(*) AS rows,"
    f' count(*) - count("{field}") AS missing, count(*) = count("{field}") AS passed'
    f" FROM {table}"
    for table, fields in FIELDS.items()
    for field in fields.split()
)


def _outcomes_sql() -> str:
    """Rows per table, day and first broken field: enums first, then missing values."""
    parts = []
    for table, fields in FIELDS.items():
        enums = {f: allowed for (t, f), allowed in CONTRACT.items() if t == table}
        cases = [
            f"WHEN coalesce({f} NOT IN {allowed}, true) THEN '{f}'"
            for f, allowed in enums.items()
        ] + [f"WHEN \"{f}\" IS NULL THEN '{f}'" for f in fields.split() if f not in enums]
        parts.append(
            f"SELECT '{table}' AS table_name, {day()}, CASE {' '.join(cases)} ELSE 'none'"
            f" END AS broken_field, count(*) AS rows FROM {table} GROUP BY ALL"
        )
    return " UNION ALL ".join(parts)


def _profile_sql(contract: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{field}' AS field, {field} AS value, "
        f"coalesce({field} IN {tuple(allowed) if len(allowed) > 1 else str(tuple(allowed)).replace(',', '')}, false)"
        f" AS valid, count(*) AS rows FROM {table} GROUP BY {field}"
        for (table, field), allowed in contract.items()
    )


AA_PAIR = wide("aa", "aa_pair", "date", ["adders", "orderers"])
AA = (
    SAME_DAY
    + ","
    + NEWEST
    + """,
aa AS (SELECT variant, adders, orders AS orderers, date FROM same_day
  WHERE date = (SELECT day FROM newest))"""
)
AA_TESTED = (
    AA
    + ","
    + AA_PAIR
    + ","
    + tested(
        "aa_pair",
        "control_orderers",
        "control_adders",
        "treatment_orderers",
        "treatment_adders",
    )
)


def _orphan_message(child: str, noun: str, sample: str, shown: str) -> str:
    return f"""
SELECT CASE WHEN count(*) FILTER (WHERE b.checkout_id IS NULL) = 0
  THEN 'all ' || count(*) || ' {noun} have a checkout'
  ELSE count(*) FILTER (WHERE b.checkout_id IS NULL) || ' orphaned {noun}; sample: '
    || (SELECT string_agg({shown}, ', ' ORDER BY {shown})
        FROM (SELECT {shown} FROM {sample} ORDER BY key, detail LIMIT 5)) END
FROM {child} c LEFT JOIN (SELECT DISTINCT checkout_id FROM begin_checkout) b
  ON c.checkout_id = b.checkout_id"""


REPORT_SQL = with_tables(
    EXPERIMENTS,
    SAMPLES,
    AA_TESTED,
    f"""
messages AS (
  SELECT 'orders reference checkouts' AS name,
    ({_orphan_message('order_completed', 'orders', 'order_sample', 'detail')}) AS message
  UNION ALL SELECT 'steps reference checkouts',
    ({_orphan_message('checkout_step_view', 'step views', 'step_sample', 'key')})
  UNION ALL SELECT 'enum values', CASE WHEN count(*) = 0 THEN 'all enum values are allowed'
    ELSE count(*) || ' invalid values in ' || CAST(sum(rows) AS BIGINT) || ' rows' END
    FROM ({_profile_sql(ENUM_VALUES)}) WHERE NOT valid
  UNION ALL SELECT 'randomization balance',
    'treatment share ' || printf('%.2f', round((count(*) FILTER (WHERE variant = 'treatment')
      * 100.0::DOUBLE / count(*)) + sign(count(*) FILTER (WHERE variant = 'treatment')
      * 100.0::DOUBLE / count(*)) * 1e-5, 2)) || '% (band 48-52%)' FROM experiments
  UNION ALL SELECT 'timestamp order', CASE WHEN (SELECT count(*) FROM early_steps) = 0
    THEN 'all ' || count(DISTINCT checkout_id) || ' checkouts are in order'
    ELSE (SELECT count(*) FROM early_steps) || ' checkouts start before they begin; sample: '
      || (SELECT string_agg(key, ', ' ORDER BY key)
          FROM (SELECT key FROM early_sample ORDER BY key, detail LIMIT 5)) END
    FROM checkout_step_view
  UNION ALL SELECT 'A/A difference', 'control ' || control_orderers || '/' || control_adders
    || ', treatment ' || treatment_orderers || '/' || treatment_adders
    || ', p=' || printf('%.4f', round((p_value) + sign(p_value) * 1e-7, 4)) FROM tested)""",
    select="""
SELECT name, CASE name WHEN 'enum values' THEN message LIKE 'all %'
    WHEN 'randomization balance' THEN (SELECT round((count(*) FILTER (WHERE
      variant = 'treatment') * 100.0::DOUBLE / count(*)) + sign(count(*) FILTER (WHERE
      variant = 'treatment') * 100.0::DOUBLE / count(*)) * 1e-5, 2) BETWEEN 48 AND 52 FROM experiments)
    WHEN 'A/A difference' THEN (SELECT p_value >= 0.05 FROM tested)
    ELSE message LIKE 'all %' END AS passed, message
FROM messages""",
)


FUNNEL_SQL = """
SELECT v.variant, coalesce(a.n, 0) AS adders, coalesce(b.n, 0) AS begin_checkout,
  coalesce(p.n, 0) AS payment_attempts, coalesce(o.n, 0) AS orders{extra}
FROM (
  SELECT variant FROM add_to_cart WHERE {day} = (SELECT day FROM newest)
  UNION SELECT variant FROM begin_checkout WHERE {day} = (SELECT day FROM newest)
  UNION SELECT variant FROM payment_attempt WHERE {day} = (SELECT day FROM newest)
  UNION SELECT variant FROM order_completed WHERE {day} = (SELECT day FROM newest)) v
LEFT JOIN (SELECT variant, count(DISTINCT user_id) AS n FROM add_to_cart
      WHERE {day} = (SELECT day FROM newest) GROUP BY 1) a ON v.variant = a.variant
LEFT JOIN (SELECT variant, count(DISTINCT checkout_id) AS n FROM begin_checkout
      WHERE {day} = (SELECT day FROM newest) GROUP BY 1) b ON v.variant = b.variant
LEFT JOIN (SELECT variant, count(*) AS n FROM payment_attempt
      WHERE {day} = (SELECT day FROM newest) GROUP BY 1) p ON v.variant = p.variant
LEFT JOIN (SELECT variant, count(*) AS n FROM order_completed
      WHERE {day} = (SELECT day FROM newest) GROUP BY 1) o ON v.variant = o.variant"""

EVENT_FUNNEL_SQL = with_tables(
    NEWEST, select=FUNNEL_SQL.format(day='CAST("timestamp" AS DATE)', extra="")
)

QUERIES: dict[str, Query] = {
    "scan_events": Query(on_events(scan_summary), SCAN_SQL),
    "sink_roundtrip": Query(lake_roundtrip, SCAN_SQL),
    "event_views": Query(
        views_through_sql,
        with_tables(
            select=f"""
SELECT {day()}, variant, count(*) AS orders, {r('avg(order_value)', 'aov')}
FROM order_completed GROUP BY date, variant"""
        ),
    ),
    "mart_tables": Query(
        mart_tables,
        with_tables(
            EXPERIMENTS,
            STEP_JOIN,
            select=" UNION ALL ".join(
                f"SELECT '{mart}' AS mart, variant, count(*) AS rows,"
                f" count(DISTINCT {key}) AS keys, {moment(f'min({at})', 'first_at')},"
                f" {moment(f'max({at})', 'last_at')} FROM {source} GROUP BY variant"
                for mart, source, key, at in (
                    ("fct_experiments", "experiments", "user_id", "first_exposed_at"),
                    ("fct_checkout_steps", "steps", "checkout_id", "first_seen_at"),
                    ("fct_orders", "order_completed", "checkout_id", '"timestamp"'),
                )
            ),
        ),
    ),
    "funnel_csv_roundtrip": Query(funnel_csv, EVENT_FUNNEL_SQL),
    "run_metadata": Query(
        on_events(run_metadata),
        with_tables(
            NEWEST,
            select=f"""
SELECT '2024-01-31T00:00:00Z' AS run_at, {day('day', 'date_analyzed')},
  'local' AS revision, 'checkout_redesign_v1' AS experiment_name, CAST(42 AS BIGINT) AS seed
FROM newest""",
        ),
    ),
    "most_recent_date": Query(
        on_events(most_recent_date),
        with_tables(
            NEWEST,
            select=f"""
SELECT {day('date', 'max_date')}, count(*) AS row_count FROM add_to_cart
WHERE date = (SELECT day FROM newest) GROUP BY date""",
        ),
    ),
    "mart_experiments": Query(
        on_events(marts.experiments),
        with_tables(
            EXPERIMENTS,
            select=f"""
SELECT user_id, variant, {moment('first_exposed_at', 'first_exposed_at')}
FROM experiments""",
        ),
    ),
    "mart_checkout_steps": Query(
        on_events(marts.checkout_steps), with_tables(STEP_JOIN, select=STEP_OUTPUT)
    ),
    "mart_checkout_steps_exact": Query(
        on_events(marts.checkout_steps_exact),
        with_tables(STEPS_EXACT, select=STEP_OUTPUT),
    ),
    "mart_orders": Query(
        on_events(marts.orders),
        with_tables(
            select=f"""
SELECT order_id, checkout_id, user_id, {r('order_value')}, currency, variant,
  {moment('timestamp', 'ordered_at')} FROM order_completed"""
        ),
    ),
    "dq_orphan_orders": Query(
        on_events(quality.orphan_orders), _integrity_sql("order_completed")
    ),
    "dq_orphan_steps": Query(
        on_events(quality.orphan_steps), _integrity_sql("checkout_step_view")
    ),
    "dq_samples": Query(
        on_events(quality.violation_samples),
        with_tables(
            SAMPLES,
            select="""
SELECT 'orphan_orders' AS "check", left(key, 20) AS key, detail FROM order_sample
UNION ALL SELECT 'orphan_steps', left(key, 20), detail FROM step_sample
UNION ALL SELECT 'timestamp_order', left(key, 20), detail FROM early_sample""",
        ),
    ),
    "dq_enum_values": Query(
        on_events(lambda events: quality.enum_profile(events, CONTRACT_ENUMS)),
        with_tables(select=_profile_sql(CONTRACT)),
    ),
    "dq_enum_violations": Query(
        on_events(quality.enum_summary),
        with_tables(
            select=f"""
SELECT table_name, field, count(*) AS distinct_values,
  count(*) FILTER (WHERE NOT valid) AS bad_values,
  CAST(coalesce(sum(rows) FILTER (WHERE NOT valid), 0) AS BIGINT) AS bad_rows,
  count(*) FILTER (WHERE NOT valid) = 0 AS passed
FROM ({_profile_sql(CONTRACT)}) GROUP BY 1, 2"""
        ),
    ),
    "dq_required_fields": Query(
        on_events(quality.required_fields), with_tables(select=REQUIRED_SQL)
    ),
    "contract_quarantine": Query(
        on_events(quality.contract_outcomes), with_tables(select=_outcomes_sql())
    ),
    "variant_balance": Query(
        on_events(quality.variant_balance),
        with_tables(
            EXPERIMENTS,
            select="""
SELECT variant, users, percentage,
  coalesce(max(percentage) FILTER (WHERE variant = 'treatment') OVER () BETWEEN 48 AND 52,
    false) AS in_band
FROM (SELECT variant, count(*) AS users,
  round((count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()) + sign(count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()) * 1e-5, 2) AS percentage
  FROM experiments GROUP BY variant)""",
        ),
    ),
    "variant_balance_latest": Query(
        on_events(metrics.variant_balance_latest),
        with_tables(
            NEWEST,
            select="""
SELECT variant, count(DISTINCT user_id) AS users,
  round((count(DISTINCT user_id) * 100.0::DOUBLE / sum(count(DISTINCT user_id)) OVER ()) + sign(count(DISTINCT user_id) * 100.0::DOUBLE / sum(count(DISTINCT user_id)) OVER ()) * 1e-4, 1) AS pct
FROM add_to_cart WHERE date = (SELECT day FROM newest) GROUP BY variant""",
        ),
    ),
    "dq_timestamp_order": Query(
        on_events(quality.timestamp_order),
        with_tables(
            EARLY_STEPS,
            select="""
SELECT count(DISTINCT checkout_id) AS checkouts,
  (SELECT count(*) FROM early_steps) AS violations,
  (SELECT count(*) FROM early_steps) = 0 AS passed FROM checkout_step_view""",
        ),
    ),
    "aa_counts": Query(
        on_events(quality.aa_counts),
        with_tables(AA, select=f"SELECT variant, adders, orderers, {day()} FROM aa"),
    ),
    "aa_test": Query(
        on_events(quality.aa_test),
        with_tables(
            AA_TESTED,
            select=f"""
SELECT {day()}, control_adders, control_orderers, treatment_adders, treatment_orderers,
  {TEST_OUTPUT}, coalesce(p_value >= 0.05, false) AS passed FROM tested""",
        ),
    ),
    "dq_report": Query(
        on_events(lambda events: quality.report(events, aa_mode=True)), REPORT_SQL
    ),
    "cart_to_checkout_rate": Query(
        on_events(metrics.cart_to_checkout),
        with_tables(
            select=f"""
SELECT c AS add_to_cart, b AS begin_checkout, {r('b / c', 'rate')}, b / c < 0.6 AS below_floor
FROM (SELECT (SELECT count(*) FROM add_to_cart) AS c,
  (SELECT count(*) FROM begin_checkout) AS b)"""
        ),
    ),
}
