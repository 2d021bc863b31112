"""Funnel, error, latency, payment and time-of-day diagnostics; streaming monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitlane.operators import diagnostics
from splitlane.plans.common import (
    GUARDRAILS,
    SAME_DAY,
    UNITS,
    Query,
    day,
    on_events,
    presentable,
    r,
    tested_conversion,
    two_sided_p,
    wide,
    with_tables,
)
from splitlane.streaming.monitor import accounted, monitor_activity_log, monitored_activity_log

HOURLY = (
    UNITS
    + """,
hourly AS (
  SELECT u.variant, u.converted, f.hour FROM units u JOIN (
    SELECT date, user_id, variant, hour(min("timestamp")) AS hour FROM add_to_cart
    GROUP BY 1, 2, 3) f
  ON u.date = f.date AND u.user_id = f.user_id AND u.variant = f.variant)"""
)


def _seconds(start: str, end: str) -> str:
    return f"date_diff('millisecond', {start}, {end}) / 1000.0::DOUBLE"


CLOSED_DAYS = """
outcomes AS (
  SELECT "timestamp", variant, 1 AS attempt, CAST(authorized AS INTEGER) AS authorized,
    0 AS ordered, 0::DOUBLE AS order_value
  FROM (SELECT DISTINCT checkout_id, payment_method, "timestamp", variant, authorized
        FROM payment_attempt)
  UNION ALL SELECT "timestamp", variant, 0, 0, 1, order_value FROM order_completed),
closed AS (
  SELECT CAST("timestamp" AS DATE) AS date, variant, CAST(sum(attempt) AS BIGINT)
      AS total_attempts, CAST(sum(authorized) AS BIGINT) AS authorized,
    CAST(sum(ordered) AS BIGINT) AS order_count, sum(order_value) AS order_value
  FROM outcomes GROUP BY 1, 2)"""


def monitor_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, _ = monitor_activity_log(spark, sf_dir, "events.parquet")
    return presentable(days)


def monitor_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitored_activity_log(spark, sf_dir, "events.parquet")
    return presentable(accounted(spark, out))


def monitor_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, verdicts = monitor_activity_log(spark, sf_dir, "events.parquet")
    return presentable(verdicts.drop("message"))


QUERIES: dict[str, Query] = {
    "gross_conversion": Query(
        on_events(diagnostics.gross_conversion),
        with_tables(
            UNITS,
            select=f"""
SELECT variant, count(*) AS sessions, count(*) FILTER (WHERE converted) AS converted_sessions,
  {r('count(*) FILTER (WHERE converted) / count(*)', 'gross_conversion')}
FROM (SELECT s.session_id, s.variant, bool_or(u.converted) AS converted
  FROM (SELECT DISTINCT session_id, date, user_id, variant FROM add_to_cart) s
  LEFT JOIN units u ON s.date = u.date AND s.user_id = u.user_id AND s.variant = u.variant
  GROUP BY 1, 2) GROUP BY variant""",
        ),
    ),
    "step_through": Query(
        on_events(diagnostics.step_through),
        with_tables(
            """
touches AS (
  SELECT date, variant, 'a' AS stage, user_id AS key FROM add_to_cart
  UNION ALL SELECT date, variant, 'b', checkout_id FROM begin_checkout
  UNION ALL SELECT date, variant, 'p', checkout_id FROM payment_attempt
  UNION ALL SELECT date, variant, 'o', checkout_id FROM order_completed),
stages AS (
  SELECT date, variant, count(DISTINCT key) FILTER (WHERE stage = 'a') AS adders,
    count(DISTINCT key) FILTER (WHERE stage = 'b') AS begun,
    count(DISTINCT key) FILTER (WHERE stage = 'p') AS paid,
    count(DISTINCT key) FILTER (WHERE stage = 'o') AS ordered
  FROM touches GROUP BY 1, 2),
rates AS (SELECT *, begun / nullif(adders, 0) AS c, paid / nullif(begun, 0) AS b,
  ordered / nullif(paid, 0) AS o FROM stages)""",
            select=f"""
SELECT {day()}, variant, adders, begun, paid, ordered, {r('c', 'cart_to_begin')},
  {r('b', 'begin_to_payment')}, {r('o', 'payment_to_order')},
  CASE WHEN c = least(c, b, o) THEN 'cart_to_begin' WHEN b = least(c, b, o)
    THEN 'begin_to_payment' WHEN o = least(c, b, o) THEN 'payment_to_order' END AS largest_drop
FROM rates""",
        ),
    ),
    "step_abandonment": Query(
        on_events(diagnostics.step_abandonment),
        with_tables(
            select=f"""
SELECT variant, step_index, count(*) AS abandoned,
  {r('count(*) / sum(count(*)) OVER (PARTITION BY variant)', 'share')}
FROM (SELECT checkout_id, variant, max(step_index) AS step_index FROM checkout_step_view
  WHERE checkout_id NOT IN (SELECT checkout_id FROM order_completed) GROUP BY 1, 2)
GROUP BY 1, 2"""
        ),
    ),
    "form_error_rate": Query(
        on_events(diagnostics.form_error_rate),
        with_tables(
            select=f"""
SELECT b.variant, b.checkouts, coalesce(e.errors, 0) AS errors,
  {r('coalesce(e.errors, 0) / b.checkouts', 'errors_per_checkout')}
FROM (SELECT variant, count(DISTINCT checkout_id) AS checkouts FROM begin_checkout GROUP BY 1) b
LEFT JOIN (SELECT variant, count(*) AS errors FROM form_error GROUP BY 1) e
  ON b.variant = e.variant"""
        ),
    ),
    "error_mix": Query(
        on_events(diagnostics.error_mix),
        with_tables(
            select=f"""
SELECT variant, step_name, field_name, errors, {r('share')}, rank FROM (
  SELECT *, errors / sum(errors) OVER (PARTITION BY variant) AS share,
    row_number() OVER (PARTITION BY variant ORDER BY errors DESC, step_name, field_name) AS rank
  FROM (SELECT variant, step_name, field_name, count(*) AS errors FROM form_error
        GROUP BY 1, 2, 3)) WHERE rank <= 10"""
        ),
    ),
    "multi_error_sessions": Query(
        on_events(diagnostics.multi_error_sessions),
        with_tables(
            select=f"""
SELECT variant, count(*) AS checkouts_with_errors,
  count(*) FILTER (WHERE errors >= 3) AS multi_error_checkouts,
  count(*) FILTER (WHERE bought) AS completed_despite_errors,
  {r('count(*) FILTER (WHERE errors >= 3) / count(*)', 'multi_error_rate')},
  {r('count(*) FILTER (WHERE bought) / count(*)', 'completion_rate')}
FROM (SELECT checkout_id, variant, count(*) AS errors,
    checkout_id IN (SELECT checkout_id FROM order_completed) AS bought
  FROM form_error GROUP BY 1, 2) GROUP BY 1"""
        ),
    ),
    "error_sequences": Query(
        on_events(diagnostics.error_sequences),
        with_tables(
            """
linked AS (SELECT step_name || ':' || error_code AS error,
  lag(step_name || ':' || error_code) OVER (PARTITION BY checkout_id
    ORDER BY "timestamp", step_name, field_name, error_code) AS previous_error
  FROM form_error)""",
            select=f"""
SELECT previous_error, error, count(*) AS times,
  {r('count(*) / sum(count(*)) OVER ()', 'share')}
FROM linked WHERE previous_error IS NOT NULL GROUP BY 1, 2""",
        ),
    ),
    "step_backtracks": Query(
        on_events(diagnostics.step_backtracks),
        with_tables(
            """
linked AS (SELECT variant, step_index, lag(step_index) OVER (PARTITION BY checkout_id
    ORDER BY "timestamp", step_index, latency_ms) AS before FROM checkout_step_view)""",
            select=f"""
SELECT variant, count(*) AS views, count(*) FILTER (WHERE step_index < before) AS backtracks,
  count(*) FILTER (WHERE step_index = before) AS revisits,
  {r('count(*) FILTER (WHERE step_index < before) / count(*)', 'backtrack_rate')}
FROM linked GROUP BY 1""",
        ),
    ),
    "time_in_step": Query(
        on_events(diagnostics.time_in_step),
        with_tables(
            """
linked AS (SELECT step_name, variant, "timestamp" AS seen, lead("timestamp") OVER (
    PARTITION BY checkout_id ORDER BY "timestamp", step_index, latency_ms) AS next_seen
  FROM checkout_step_view)""",
            select=f"""
SELECT step_name, variant,
  {r(f"quantile_cont({_seconds('seen', 'next_seen')}, 0.5)", 'median_seconds')},
  count(*) AS transitions FROM linked WHERE next_seen IS NOT NULL GROUP BY 1, 2""",
        ),
    ),
    "completion_time": Query(
        on_events(diagnostics.completion_time),
        with_tables(
            select=f"""
SELECT coalesce(b.variant, o.variant) AS variant,
  {r(f"quantile_cont({_seconds('b.at', 'o.at')}, 0.5) FILTER (WHERE o.at >= b.at)", 'median_seconds')},
  count(*) FILTER (WHERE o.at >= b.at) AS completed,
  count(*) FILTER (WHERE o.at < b.at) AS negative_spans,
  count(*) FILTER (WHERE o.at IS NULL) AS unfinished, count(*) FILTER (WHERE b.at IS NULL) AS unbegun
FROM (SELECT checkout_id, variant, min("timestamp") AS at FROM begin_checkout GROUP BY 1, 2) b
FULL JOIN (SELECT checkout_id, variant, min("timestamp") AS at FROM order_completed GROUP BY 1, 2) o
  ON b.checkout_id = o.checkout_id AND b.variant = o.variant
GROUP BY 1"""
        ),
    ),
    "latency_percentiles": Query(
        on_events(diagnostics.latency_percentiles),
        with_tables(
            select=f"""
SELECT step_name, variant, {r('quantile_cont(latency_ms, 0.5)', 'p50')},
  {r('quantile_cont(latency_ms, 0.95)', 'p95')}, {r('quantile_cont(latency_ms, 0.99)', 'p99')},
  max(latency_ms) AS max_ms,
  {r('count(*) FILTER (WHERE latency_ms > 3000) / count(*)', 'slow_share')},
  {r('count(*) FILTER (WHERE latency_ms > 10000) / count(*)', 'timeout_share')}
FROM checkout_step_view GROUP BY 1, 2"""
        ),
    ),
    "latency_guardrail": Query(
        on_events(diagnostics.latency_guardrail),
        with_tables(
            """
tails AS (SELECT date, variant, quantile_cont(latency_ms, 0.95) AS p95
  FROM checkout_step_view WHERE step_name = 'payment' GROUP BY 1, 2)""",
            wide("tails", "pair", "date", ["p95"]),
            """
judged AS (SELECT *, treatment_p95 - control_p95 AS delta,
  coalesce(treatment_p95 - control_p95 <= 150, false) AS passed FROM pair)""",
            select=f"""
SELECT {day()}, 'payment_latency_p95' AS metric, {r('control_p95', 'baseline')},
  {r('treatment_p95', 'treatment')}, 'max_increase_ms' AS rule_type,
  150::DOUBLE AS threshold, {r('delta')}, passed,
  CASE WHEN delta IS NULL THEN 'no baseline to compare with: fail' ELSE 'increase of '
    || printf('%.3f', round((delta) + sign(delta) * 1e-6, 3)) || 'ms against a limit of 150.000ms: '
    || CASE WHEN passed THEN 'pass' ELSE 'fail' END END AS message FROM judged""",
        ),
    ),
    "conversion_by_latency": Query(
        on_events(diagnostics.conversion_by_latency),
        with_tables(
            select=f"""
SELECT CASE WHEN slowest < 1000 THEN 'under 1s' WHEN slowest < 2000 THEN '1s to 2s'
    WHEN slowest <= 3000 THEN '2s to 3s' ELSE 'over 3s' END AS bucket,
  count(*) AS checkouts, count(*) FILTER (WHERE bought) AS converted,
  {r('count(*) FILTER (WHERE bought) / count(*)', 'conversion')}
FROM (SELECT checkout_id, max(latency_ms) AS slowest,
    checkout_id IN (SELECT checkout_id FROM order_completed) AS bought
  FROM checkout_step_view GROUP BY 1) GROUP BY 1"""
        ),
    ),
    "auth_by_method": Query(
        on_events(diagnostics.auth_by_method),
        with_tables(
            select=f"""
SELECT payment_method, variant, count(*) AS attempts,
  count(*) FILTER (WHERE authorized) AS authorized_attempts,
  {r('count(*) FILTER (WHERE authorized) / count(*)', 'auth_rate')},
  {r('count(*) FILTER (WHERE NOT authorized) / count(*)', 'decline_rate')},
  {r('count(*) / sum(count(*)) OVER (PARTITION BY variant)', 'mix')}
FROM payment_attempt GROUP BY 1, 2"""
        ),
    ),
    "payment_retry_rate": Query(
        on_events(diagnostics.payment_retry_rate),
        with_tables(
            select=f"""
SELECT variant, count(*) AS checkouts, count(*) FILTER (WHERE attempts >= 2) AS retried,
  {r('count(*) FILTER (WHERE attempts >= 2) / count(*)', 'retry_rate')}
FROM (SELECT checkout_id, variant, count(*) AS attempts FROM payment_attempt GROUP BY 1, 2)
GROUP BY 1"""
        ),
    ),
    "ccr_by_hour": Query(
        on_events(diagnostics.ccr_by_hour),
        with_tables(
            HOURLY,
            select=f"""
SELECT hour, variant, count(*) AS adders, count(*) FILTER (WHERE converted) AS orders,
  {r('count(*) FILTER (WHERE converted) / count(*)', 'ccr')} FROM hourly GROUP BY 1, 2""",
        ),
    ),
    "traffic_by_hour": Query(
        on_events(diagnostics.traffic_by_hour),
        with_tables(
            select=f"""
SELECT h.hour, coalesce(b.checkouts, 0) AS checkouts, {r('v.p50', 'p50_ms')},
  {r('v.p95', 'p95_ms')}, coalesce(p.attempts, 0) AS attempts,
  coalesce(p.authorized, 0) AS authorized_attempts,
  {r('p.authorized / p.attempts', 'auth_rate')},
  row_number() OVER (ORDER BY coalesce(b.checkouts, 0) DESC, h.hour) = 1 AS peak
FROM (SELECT hour("timestamp") AS hour FROM begin_checkout
  UNION SELECT hour("timestamp") FROM checkout_step_view
  UNION SELECT hour("timestamp") FROM payment_attempt) h
LEFT JOIN (SELECT hour("timestamp") AS hour, count(*) AS checkouts FROM begin_checkout
  GROUP BY 1) b ON h.hour = b.hour
LEFT JOIN (SELECT hour("timestamp") AS hour, quantile_cont(latency_ms, 0.5) AS p50,
  quantile_cont(latency_ms, 0.95) AS p95 FROM checkout_step_view GROUP BY 1) v
  ON h.hour = v.hour
LEFT JOIN (SELECT hour("timestamp") AS hour, count(*) AS attempts,
  count(*) FILTER (WHERE authorized) AS authorized FROM payment_attempt GROUP BY 1) p
  ON h.hour = p.hour"""
        ),
    ),
    "ccr_by_weekday": Query(
        on_events(diagnostics.ccr_by_weekday),
        with_tables(
            UNITS,
            select=f"""
SELECT isodow(date) - 1 AS weekday, variant, count(*) AS adders,
  count(*) FILTER (WHERE converted) AS orders,
  {r('count(*) FILTER (WHERE converted) / count(*)', 'ccr')} FROM units GROUP BY 1, 2""",
        ),
    ),
    "weekend_uplift": Query(
        on_events(diagnostics.weekend_uplift),
        with_tables(
            UNITS,
            """
rates AS (SELECT variant,
  count(*) FILTER (WHERE converted AND isodow(date) > 5)
    / nullif(count(*) FILTER (WHERE isodow(date) > 5), 0) AS we,
  count(*) FILTER (WHERE converted AND isodow(date) <= 5)
    / nullif(count(*) FILTER (WHERE isodow(date) <= 5), 0) AS wd FROM units GROUP BY 1)""",
            select=f"""
SELECT variant, {r('we', 'weekend_ccr')}, {r('wd', 'weekday_ccr')},
  {r('we / nullif(wd, 0)', 'weekend_uplift')} FROM rates""",
        ),
    ),
    "srm_by_hour": Query(
        on_events(diagnostics.srm_by_hour),
        with_tables(
            HOURLY,
            """
split AS (SELECT CASE WHEN grouping(hour) = 1 THEN 'all' ELSE CAST(hour AS VARCHAR) END
    AS scope, count(*) FILTER (WHERE variant = 'control') AS c,
    count(*) FILTER (WHERE variant = 'treatment') AS t
  FROM hourly GROUP BY GROUPING SETS ((hour), ())),
chi AS (SELECT *, (c - t) * (c - t) / (c + t) AS x, sqrt((c - t) * (c - t) / (c + t)) AS z
  FROM split)""",
            select=f"""
SELECT scope, c AS control_users, t AS treatment_users, {r('x', 'chi_square')},
  {r(two_sided_p('z'), 'p_value')}, {two_sided_p('z')} < 0.05 AS mismatch FROM chi""",
        ),
    ),
    "hourly_variability": Query(
        on_events(diagnostics.hourly_variability),
        with_tables(
            select=f"""
SELECT variant, count(*) AS hours, {r('avg(n)', 'mean_checkouts')},
  {r('stddev_samp(n)', 'std_checkouts')}, max(n) AS peak_checkouts
FROM (SELECT variant, date_trunc('hour', "timestamp") AS h, count(*) AS n
  FROM begin_checkout GROUP BY 1, 2) GROUP BY 1"""
        ),
    ),
    "rollback_monitor": Query(
        on_events(diagnostics.rollback_monitor),
        with_tables(
            SAME_DAY,
            tested_conversion("same_day", "date"),
            GUARDRAILS,
            wide("guardrails", "guard_pair", "date", ["auth_rate"]),
            """
daily AS (SELECT t.date, t.effect_abs, coalesce(t.effect_abs < -0.01, false) AS breach,
    coalesce(g.treatment_auth_rate < 0.90, false) AS auth_breach
  FROM tested t LEFT JOIN guard_pair g ON t.date = g.date),
runs AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY breach ORDER BY date)
  AS INTEGER) AS run FROM daily),
counted_runs AS (SELECT *, CASE WHEN breach THEN row_number() OVER (PARTITION BY breach, run
  ORDER BY date) ELSE 0 END AS breach_days FROM runs)""",
            select=f"""
SELECT {day()}, {r('effect_abs')}, breach, auth_breach, breach_days,
  breach_days >= 3 AS rollback FROM counted_runs""",
        ),
    ),
    "monitor_stream": Query(
        monitor_days,
        with_tables(
            CLOSED_DAYS,
            select=f"""
SELECT {day()}, variant, total_attempts, authorized, order_count, {r('order_value')}
FROM closed""",
        ),
    ),
    "monitor_accounts": Query(
        monitor_accounts,
        with_tables(
            """
sent AS (
  SELECT CAST("timestamp" AS DATE) AS date, variant,
    md5(concat_ws('|', checkout_id, payment_method, authorized, "timestamp", variant, date)) AS k
  FROM payment_attempt
  UNION ALL SELECT CAST("timestamp" AS DATE), variant, order_id FROM order_completed)""",
            select=f"""
SELECT {day()}, variant, count(*) AS rows_sent, count(DISTINCT k) AS counted,
  count(*) - count(DISTINCT k) AS repeated, CAST(0 AS BIGINT) AS late,
  CAST(0 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS undated
FROM sent GROUP BY date, variant""",
        ),
    ),
    "monitor_verdicts": Query(
        monitor_verdicts,
        with_tables(
            CLOSED_DAYS,
            """
rated AS (SELECT date, variant, authorized / nullif(total_attempts, 0) * 100 AS auth_rate,
  order_value / nullif(order_count, 0) AS aov FROM closed)""",
            wide("rated", "pair", "date", ["auth_rate", "aov"]),
            """
judged AS (
  SELECT date, 'payment_auth_rate' AS metric, control_auth_rate AS baseline,
    treatment_auth_rate AS treatment, 'max_drop_pp' AS rule_type, 0.3::DOUBLE AS threshold,
    control_auth_rate - treatment_auth_rate AS delta FROM pair
  UNION ALL SELECT date, 'aov', control_aov, treatment_aov, 'max_drop_pct', 1::DOUBLE,
    (control_aov - treatment_aov) / nullif(control_aov, 0) * 100 FROM pair)""",
            select=f"""
SELECT {day()}, metric, {r('baseline')}, {r('treatment')}, rule_type, {r('threshold')},
  {r('delta')}, coalesce(delta <= threshold, false) AS passed FROM judged""",
        ),
    ),
}
