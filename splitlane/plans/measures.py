"""Conversion, guardrail, funnel and latency metrics; tests and readouts."""

from __future__ import annotations

from splitlane.functions import normal
from splitlane.operators import guardrails, marts, metrics, readout
from splitlane.plans.common import (
    EXPERIMENTS,
    FIRST_EXPOSURE,
    GUARDRAILS,
    NEWEST,
    SAME_DAY,
    TEST_OUTPUT,
    UNITS,
    Query,
    day,
    on_events,
    r,
    tested_conversion,
    wide,
    with_tables,
)
from splitlane.plans.foundation import (
    EVENT_FUNNEL_SQL,
    FUNNEL_SQL,
    STEP_JOIN,
    ccr_json,
    guardrails_json,
)
from splitlane.sources.contract import EVENT_NAMES

DAILY = tested_conversion("same_day", "date")

PAYMENT_LATENCY = """
latency AS (SELECT latency_ms FROM checkout_step_view
  WHERE step_name = 'payment' AND date = (SELECT day FROM newest))"""

SUMMARY_SQL = with_tables(
    GUARDRAILS,
    """
interval AS (SELECT *, 1.96::DOUBLE * sqrt(auth_rate * (1 - auth_rate) / total_attempts)
  AS margin FROM guardrails)""",
    select=f"""
SELECT {day()}, variant, {r('auth_rate', 'rate')},
  {r('greatest(0, auth_rate - margin)', 'ci_low')},
  {r('least(1, auth_rate + margin)', 'ci_high')}, authorized, total_attempts,
  {r('aov', 'mean_order_value')}, order_count FROM interval""",
)


def _coefficients(values) -> str:
    return " + ".join(f"{c!r}::DOUBLE * pow(t, {i})" for i, c in enumerate(values))


Z_SQL = with_tables(
    """
looks AS (SELECT date, 0.05::DOUBLE
    / (date - (SELECT min(date) FROM add_to_cart) + 1) AS alpha
  FROM (SELECT DISTINCT date FROM add_to_cart)),
tails AS (SELECT *, sqrt(-2 * ln(alpha / 2)) AS t FROM looks)""",
    select=f"""
SELECT {day()}, {r('alpha')}, {r(
    "CASE WHEN abs(alpha / 2 - 0.025) < 1e-6 THEN 1.96::DOUBLE "
    "WHEN abs(alpha / 2 - 0.005) < 1e-6 THEN 2.576::DOUBLE ELSE "
    f"t - ({_coefficients(normal.PROBIT_NUMERATOR)}) / "
    f"({_coefficients(normal.PROBIT_DENOMINATOR)}) END", "z_crit")} FROM tails""",
)

EVALUATED = (
    GUARDRAILS
    + ","
    + wide("guardrails", "guard_pair", "date", ["auth_rate", "aov"])
    + """,
judged AS (
  SELECT *, coalesce(delta <= threshold, false) AS passed FROM (
    SELECT date, 'payment_auth_rate' AS metric, control_auth_rate * 100 AS baseline,
      treatment_auth_rate * 100 AS treatment, 'max_drop_pp' AS rule_type,
      0.3::DOUBLE AS threshold,
      control_auth_rate * 100 - treatment_auth_rate * 100 AS delta FROM guard_pair
    UNION ALL
    SELECT date, 'aov', control_aov, treatment_aov, 'max_drop_pct', 1.0::DOUBLE,
      (control_aov - treatment_aov) / nullif(control_aov, 0) * 100 FROM guard_pair))"""
)

MESSAGE = """
CASE WHEN delta IS NULL THEN 'no baseline to compare with: fail' ELSE
  'drop of ' || printf('%.3f', round((delta) + sign(delta) * 1e-6, 3))
  || CASE WHEN rule_type LIKE '%pct' THEN '%' ELSE 'pp' END
  || ' against a limit of ' || printf('%.3f', threshold)
  || CASE WHEN rule_type LIKE '%pct' THEN '%' ELSE 'pp' END || ': '
  || CASE WHEN passed THEN 'pass' ELSE 'fail' END END AS message"""


def _label(pattern: str, expression: str, places: int, name: str) -> str:
    shown = f"round(({expression}) + sign({expression}) * 1e-{places + 3}, {places})"
    return f"CASE WHEN {shown} IS NOT NULL THEN printf('{pattern}', {shown}) END AS {name}"


def _pretty(x: str, name: str) -> str:
    return r(
        f"CASE WHEN abs({x}) >= 100 THEN round(({x}) + sign({x}) * 1e-4, 1) WHEN abs({x}) >= 1"
        f" THEN round(({x}) + sign({x}) * 1e-5, 2) WHEN abs({x}) >= 0.01 THEN round(({x}) + sign({x}) * 1e-6, 3)"
        f" ELSE round(({x}) + sign({x}) * 1e-7, 4) END",
        name,
    )


def _ccr_cells_sql(source: str, *ctes: str) -> str:
    return with_tables(
        *ctes, select=f"SELECT {day()}, variant, adders, orders FROM {source}"
    )


QUERIES: dict[str, Query] = {
    "ccr_counts": Query(
        on_events(metrics.ccr_first_exposure),
        _ccr_cells_sql("first_exposure", FIRST_EXPOSURE),
    ),
    "ccr_same_day": Query(
        on_events(metrics.ccr_same_day), _ccr_cells_sql("same_day", SAME_DAY)
    ),
    "ccr_compact": Query(
        on_events(metrics.ccr_compact),
        with_tables(
            NEWEST,
            select="""
SELECT a.variant, a.adders, coalesce(o.orders, 0) AS orders,
  round((coalesce(o.orders, 0) * 100.0::DOUBLE / a.adders) + sign(coalesce(o.orders, 0) * 100.0::DOUBLE / a.adders) * 1e-4, 1) AS conditional_conversion_pct
FROM (SELECT variant, count(DISTINCT user_id) AS adders FROM add_to_cart
      WHERE date = (SELECT day FROM newest) GROUP BY 1) a
LEFT JOIN (SELECT variant, count(DISTINCT user_id) AS orders FROM order_completed
      WHERE date = (SELECT day FROM newest) GROUP BY 1) o ON a.variant = o.variant""",
        ),
    ),
    "ccr_window": Query(
        on_events(metrics.ccr_window),
        with_tables(
            EXPERIMENTS,
            select="""
SELECT a.variant, a.adders, coalesce(o.orderers, 0) AS orderers,
  round((coalesce(o.orderers, 0) * 100.0::DOUBLE / a.adders) + sign(coalesce(o.orderers, 0) * 100.0::DOUBLE / a.adders) * 1e-4, 1) AS conv_rate
FROM (SELECT variant, count(*) AS adders FROM experiments GROUP BY 1) a
LEFT JOIN (SELECT variant, count(DISTINCT user_id) AS orderers FROM order_completed
      GROUP BY 1) o ON a.variant = o.variant""",
        ),
    ),
    "ccr_rollup": Query(
        on_events(metrics.ccr_rollup),
        with_tables(
            UNITS,
            select=f"""
SELECT scope, variant, adders, orders, {r('orders / adders', 'ccr')} FROM (
  SELECT CASE WHEN grouping(date) = 1 THEN 'total' ELSE CAST(date AS VARCHAR) END AS scope,
    variant, count(DISTINCT user_id) AS adders,
    count(DISTINCT CASE WHEN converted THEN user_id END) AS orders
  FROM units GROUP BY GROUPING SETS ((date, variant), (variant)))""",
        ),
    ),
    "guardrails": Query(
        on_events(metrics.guardrails),
        with_tables(
            GUARDRAILS,
            NEWEST,
            select=f"""
SELECT variant, total_attempts, authorized, {r('auth_rate')}, order_count, {r('aov')}, missing
FROM guardrails WHERE date = (SELECT day FROM newest)""",
        ),
    ),
    "guardrails_daily": Query(
        on_events(metrics.guardrails_daily),
        with_tables(
            GUARDRAILS,
            select=f"""
SELECT {day()}, variant, total_attempts, authorized, {r('auth_rate')}, order_count,
  {r('aov')}, missing FROM guardrails""",
        ),
    ),
    "guardrails_compact": Query(
        on_events(metrics.guardrails_compact),
        with_tables(
            select=f"""
SELECT {day('p.date')}, p.variant, p.auth_rate_pct, o.avg_order_value
FROM (SELECT date, variant, round((count(*) FILTER (WHERE authorized) * 100.0::DOUBLE
        / count(*)) + sign(count(*) FILTER (WHERE authorized) * 100.0::DOUBLE
        / count(*)) * 1e-4, 1) AS auth_rate_pct FROM payment_attempt GROUP BY 1, 2) p
JOIN (SELECT date, variant, round((avg(order_value)) + sign(avg(order_value)) * 1e-5, 2) AS avg_order_value
      FROM order_completed GROUP BY 1, 2) o ON p.date = o.date AND p.variant = o.variant"""
        ),
    ),
    "guardrails_latest": Query(
        on_events(metrics.guardrails_latest),
        with_tables(
            NEWEST,
            select="""
SELECT p.variant, p.auth_rate_pct, o.avg_order_value
FROM (SELECT variant, round((count(*) FILTER (WHERE authorized) * 100.0::DOUBLE
        / count(*)) + sign(count(*) FILTER (WHERE authorized) * 100.0::DOUBLE
        / count(*)) * 1e-4, 1) AS auth_rate_pct FROM payment_attempt, newest
      WHERE date = newest.day GROUP BY 1) p
JOIN (SELECT variant, round((avg(order_value)) + sign(avg(order_value)) * 1e-5, 2) AS avg_order_value
      FROM order_completed, newest WHERE date = newest.day GROUP BY 1) o
  ON p.variant = o.variant""",
        ),
    ),
    "summary_stats": Query(
        on_events(metrics.summary_stats),
        with_tables(
            EXPERIMENTS,
            """
stat_rows AS (
  SELECT CAST(first_exposed_at AS DATE) AS date, variant, count(*) AS adders, 0 AS orders,
    0 AS total_attempts, 0 AS authorized, 0 AS order_count, NULL::DOUBLE AS aov
  FROM experiments GROUP BY 1, 2
  UNION ALL
  SELECT CAST("timestamp" AS DATE), variant, 0, 0, count(*),
    count(*) FILTER (WHERE authorized), 0, NULL FROM payment_attempt GROUP BY 1, 2
  UNION ALL
  SELECT CAST("timestamp" AS DATE), variant, 0, count(DISTINCT user_id), 0, 0, count(*),
    avg(order_value) FROM order_completed GROUP BY 1, 2),
stats AS (
  SELECT date, variant, CAST(sum(adders) AS BIGINT) AS adders,
    CAST(sum(orders) AS BIGINT) AS orders,
    CAST(sum(total_attempts) AS BIGINT) AS total_attempts,
    CAST(sum(authorized) AS BIGINT) AS authorized,
    CAST(sum(order_count) AS BIGINT) AS order_count, max(aov) AS aov
  FROM stat_rows GROUP BY 1, 2)""",
            select=f"""
SELECT {day()}, variant, adders, orders, total_attempts, authorized, order_count,
  {r('authorized / nullif(total_attempts, 0)', 'auth_rate')}, {r('aov')},
  nullif(concat_ws(', ', CASE WHEN adders = 0 THEN 'first exposures' END,
    CASE WHEN total_attempts = 0 THEN 'payments' END,
    CASE WHEN order_count = 0 THEN 'orders' END), '') AS missing
FROM stats""",
        ),
    ),
    "variant_funnel": Query(on_events(metrics.variant_funnel), EVENT_FUNNEL_SQL),
    "funnel_summary": Query(
        on_events(metrics.funnel_summary),
        with_tables(
            NEWEST,
            select=FUNNEL_SQL.format(
                day="date",
                extra=", round((coalesce(o.n, 0) * 100.0::DOUBLE / nullif(a.n, 0)) + sign(coalesce(o.n, 0) * 100.0::DOUBLE / nullif(a.n, 0)) * 1e-4, 1)"
                " AS conditional_conversion_pct",
            ),
        ),
    ),
    "step_progression": Query(
        on_events(lambda events: marts.step_progression(marts.checkout_steps(events))),
        with_tables(
            STEP_JOIN,
            select="""
SELECT step_name, step_index, count(DISTINCT checkout_id) AS checkouts,
  round((avg(median_latency_ms)) + sign(avg(median_latency_ms)) * 1e-3, 0) AS avg_median_latency_ms,
  round((sum(error_events) * 100.0::DOUBLE / count(DISTINCT checkout_id)) + sign(sum(error_events) * 100.0::DOUBLE / count(DISTINCT checkout_id)) * 1e-4, 1) AS error_rate_pct
FROM steps GROUP BY 1, 2""",
        ),
    ),
    "payment_latency": Query(
        on_events(metrics.payment_latency),
        with_tables(
            NEWEST,
            PAYMENT_LATENCY,
            select=f"""
SELECT count(latency_ms) AS n, {r('avg(latency_ms)', 'mean_ms')},
  {r('quantile_cont(latency_ms, 0.5)', 'median_ms')}, min(latency_ms) AS min_ms,
  max(latency_ms) AS max_ms, {r('stddev_samp(latency_ms)', 'std_ms')} FROM latency""",
        ),
    ),
    "latency_frequency": Query(
        on_events(metrics.latency_frequency),
        with_tables(
            NEWEST,
            PAYMENT_LATENCY,
            select="SELECT latency_ms, count(*) AS views FROM latency GROUP BY 1",
        ),
    ),
    "latency_histogram": Query(
        on_events(metrics.latency_histogram),
        with_tables(
            NEWEST,
            PAYMENT_LATENCY,
            select=f"""
SELECT bin, {r('low + bin * width', 'bin_start')}, {r('low + (bin + 1) * width', 'bin_end')},
  count(*) AS views
FROM (SELECT low, width, CAST(least(floor((latency_ms - low) / width), 29) AS BIGINT) AS bin
      FROM latency, (SELECT min(latency_ms) AS low,
        (max(latency_ms) - min(latency_ms)) / 30.0::DOUBLE AS width FROM latency))
GROUP BY bin, low, width""",
        ),
    ),
    "event_counts_by_date": Query(
        on_events(metrics.event_counts_by_date),
        with_tables(
            "\ncounts AS ("
            + " UNION ALL ".join(
                f"SELECT date, '{name}' AS event_type, count(*) AS cnt FROM {name} GROUP BY date"
                for name in EVENT_NAMES
            )
            + ")",
            select=f"SELECT {day()}, "
            + ", ".join(
                f"CAST(coalesce(sum(cnt) FILTER (WHERE event_type = '{name}'), 0) AS BIGINT)"
                f" AS {name}"
                for name in EVENT_NAMES
            )
            + " FROM counts GROUP BY date",
        ),
    ),
    "exposure_overview": Query(
        on_events(metrics.exposure_overview),
        with_tables(
            EXPERIMENTS,
            select="""
SELECT count(DISTINCT user_id) AS total_users, count(DISTINCT variant) AS variants
FROM experiments""",
        ),
    ),
    "two_proportion_daily": Query(
        on_events(readout.two_proportion_daily),
        with_tables(
            SAME_DAY,
            DAILY,
            select=f"""
SELECT {day()}, control_adders, control_orders, treatment_adders, treatment_orders,
  {TEST_OUTPUT} FROM tested""",
        ),
    ),
    "ccr_summary": Query(
        on_events(readout.ccr_summary),
        with_tables(
            FIRST_EXPOSURE,
            tested_conversion("first_exposure", "date"),
            select=f"""
SELECT {day()}, control_adders, control_orders, {r('p_a', 'control_ccr')}, treatment_adders,
  treatment_orders, {r('p_b', 'treatment_ccr')}, {r('effect_abs')}, {r('effect_rel')},
  {r('p_value')}, {r('ci_low')}, {r('ci_high')}, invalid_reason,
  coalesce(p_value < 0.05, false) AS significant FROM tested""",
        ),
    ),
    "ccr_json_roundtrip": Query(
        ccr_json,
        with_tables(
            FIRST_EXPOSURE,
            tested_conversion("first_exposure", "date"),
            select=f"""
SELECT {day()}, control_adders, control_orders, {r('p_a', 'control_ccr')}, treatment_adders,
  treatment_orders, {r('p_b', 'treatment_ccr')}, {r('effect_abs')}, {r('effect_rel')},
  {r('p_value')}, {r('ci_low')}, {r('ci_high')}, coalesce(p_value < 0.05, false) AS significant FROM tested""",
        ),
    ),
    "auth_rate_ci": Query(
        on_events(readout.auth_rate_ci),
        with_tables(
            GUARDRAILS,
            select=f"""
SELECT {day()}, variant, authorized, total_attempts, {r('auth_rate', 'rate')},
  {r('greatest(0, auth_rate - 1.96 * sqrt(auth_rate * (1 - auth_rate) / total_attempts))',
     'ci_low')},
  {r('least(1, auth_rate + 1.96 * sqrt(auth_rate * (1 - auth_rate) / total_attempts))',
     'ci_high')} FROM guardrails""",
        ),
    ),
    "guardrails_summary": Query(on_events(readout.guardrails_summary), SUMMARY_SQL),
    "guardrails_json_roundtrip": Query(guardrails_json, SUMMARY_SQL),
    "aov_ci": Query(
        on_events(readout.aov_ci),
        with_tables(
            """
stats AS (SELECT CAST("timestamp" AS DATE) AS date, variant, count(order_value) AS n,
  avg(order_value) AS mean, stddev_samp(order_value) AS std FROM order_completed GROUP BY 1, 2)""",
            select=f"""
SELECT {day()}, variant, n, {r('mean')}, {r('std')},
  {r('CASE WHEN n >= 2 THEN mean - 1.96::DOUBLE * std / sqrt(n) END', 'ci_low')},
  {r('CASE WHEN n >= 2 THEN mean + 1.96::DOUBLE * std / sqrt(n) END', 'ci_high')}
FROM stats""",
        ),
    ),
    "z_critical": Query(on_events(readout.z_critical), Z_SQL),
    "guardrail_eval": Query(
        on_events(guardrails.guardrail_eval),
        with_tables(
            EVALUATED,
            select=f"""
SELECT {day()}, metric, {r('baseline')}, {r('treatment')}, rule_type, {r('threshold')},
  {r('delta')}, passed, {MESSAGE} FROM judged""",
        ),
    ),
    "ship_decision": Query(
        on_events(readout.ship_decision),
        with_tables(
            UNITS,
            """
scoped_units AS (
  SELECT CAST(date AS VARCHAR) AS scope, user_id, variant, converted FROM units
  UNION ALL SELECT 'total', user_id, variant, bool_or(converted) FROM units GROUP BY 2, 3),
scoped_cells AS (SELECT scope, variant, count(*) AS adders,
    count(*) FILTER (WHERE converted) AS orders FROM scoped_units GROUP BY 1, 2)""",
            tested_conversion("scoped_cells", "scope"),
            """
scopes AS (SELECT unnest([CAST(day AS VARCHAR), 'total']) AS scope, day
  FROM (SELECT DISTINCT date AS day FROM log)),
metric_cells AS (
  SELECT scope, variant, 'max_drop_pp' AS rule, 0.3::DOUBLE AS threshold,
    avg(CASE WHEN authorized THEN 100::DOUBLE ELSE 0 END) AS value
  FROM payment_attempt JOIN scopes ON CAST("timestamp" AS DATE) = day GROUP BY 1, 2
  UNION ALL
  SELECT scope, variant, 'max_drop_pct', 1::DOUBLE, avg(order_value)
  FROM order_completed JOIN scopes ON CAST("timestamp" AS DATE) = day GROUP BY 1, 2
  UNION ALL
  SELECT scope, variant, 'max_increase_ms', 150::DOUBLE, quantile_cont(latency_ms, 0.95)
  FROM checkout_step_view JOIN scopes ON date = day WHERE step_name = 'payment'
  GROUP BY 1, 2),
metric_pairs AS (
  SELECT scope, rule, threshold, max(value) FILTER (WHERE variant = 'control') AS base,
    max(value) FILTER (WHERE variant = 'treatment') AS treated
  FROM metric_cells GROUP BY 1, 2, 3),
verdicts AS (
  SELECT scope, coalesce(CASE rule WHEN 'max_drop_pp' THEN base - treated
      WHEN 'max_drop_pct' THEN (base - treated) / nullif(base, 0) * 100
      ELSE treated - base END <= threshold, false) AS passed FROM metric_pairs),
guarded AS (SELECT scope, count(*) FILTER (WHERE passed) = 3 AS guardrails_passed,
    3 - count(*) FILTER (WHERE passed) AS guardrails_failed FROM verdicts GROUP BY scope),
facts AS (SELECT t.*, coalesce(t.p_value < 0.05, false) AS significant,
    coalesce(g.guardrails_passed, false) AS guarded, g.guardrails_failed,
    coalesce(t.effect_abs, 0) AS lift
  FROM tested t LEFT JOIN guarded g ON t.scope = g.scope)""",
            select=f"""
SELECT scope, {r('effect_abs')}, {r('ci_low')}, {r('ci_high')}, {r('p_value')},
  invalid_reason, guarded AS guardrails_passed, guardrails_failed, significant,
  CASE WHEN significant AND guarded THEN 'SHIP' ELSE 'DO NOT SHIP' END AS decision_by_test,
  CASE WHEN significant AND lift > 0 THEN 'SHIP' WHEN significant AND lift < 0
    THEN 'DO NOT SHIP' ELSE 'INCONCLUSIVE' END AS decision_by_sign,
  CASE WHEN significant AND guarded AND lift >= 0.015 THEN 'SHIP' ELSE 'DO NOT SHIP'
    END AS decision_by_plan FROM facts""",
        ),
    ),
    "readout_labels": Query(
        on_events(readout.readout_labels),
        with_tables(
            SAME_DAY,
            DAILY,
            GUARDRAILS,
            wide("guardrails", "guard_pair", "date", ["auth_rate", "aov"]),
            select=f"""
SELECT {day('t.date')}, {_pretty('effect_abs', 'effect_rounded')},
  {_pretty('control_aov', 'aov_rounded')},
  {_label('%+.2fpp', 'effect_abs * 100', 2, 'effect_label')},
  '[' || printf('%+.2fpp', round((ci_low * 100) + sign(ci_low * 100) * 1e-5, 2)) || ', '
    || printf('%+.2fpp', round((ci_high * 100) + sign(ci_high * 100) * 1e-5, 2)) || ']' AS interval_label,
  {_label('%.1f%%', 'p_a * 100', 1, 'control_label')},
  {_label('%.1f%%', 'p_b * 100', 1, 'treatment_label')},
  {_label('%.1f%%', 'control_auth_rate * 100', 1, 'control_auth_label')},
  {_label('$%.2f', 'treatment_aov', 2, 'treatment_aov_label')}
FROM tested t LEFT JOIN guard_pair g ON t.date = g.date""",
        ),
    ),
    "dq_auth_band": Query(
        on_events(readout.auth_band),
        with_tables(
            GUARDRAILS,
            select=f"""
SELECT {day()}, variant, {r('auth_rate')}, auth_rate BETWEEN 0.85 AND 0.95 AS in_band
FROM guardrails""",
        ),
    ),
    "aa_parity": Query(
        on_events(readout.aa_parity),
        with_tables(
            GUARDRAILS,
            wide("guardrails", "guard_pair", "date", ["auth_rate", "aov"]),
            """
gaps AS (SELECT date, abs(treatment_auth_rate - control_auth_rate) * 100 AS auth_gap_pp,
  abs(treatment_aov - control_aov) AS aov_gap FROM guard_pair)""",
            select=f"""
SELECT {day()}, {r('auth_gap_pp')}, {r('aov_gap')},
  coalesce(auth_gap_pp < 0.5, false) AS auth_parity,
  coalesce(aov_gap < 2.0, false) AS aov_parity FROM gaps""",
        ),
    ),
    "impact_projection": Query(
        on_events(readout.impact_projection),
        with_tables(
            SAME_DAY,
            DAILY,
            GUARDRAILS,
            wide("guardrails", "guard_pair", "date", ["aov"]),
            """
gained AS (SELECT t.date, effect_abs,
    effect_abs * (control_adders + treatment_adders) AS orders,
    effect_abs * (control_adders + treatment_adders) * treatment_aov AS revenue,
    coalesce(invalid_reason, CASE WHEN treatment_aov IS NULL THEN 'no order value' END)
      AS reason
  FROM tested t LEFT JOIN guard_pair g ON t.date = g.date)""",
            select=f"""
SELECT {day()}, {r('effect_abs')}, {r('orders', 'incremental_orders')},
  {r('revenue', 'incremental_revenue')}, {r('revenue * 365', 'annual_revenue')},
  reason AS invalid_reason
FROM gained""",
        ),
    ),
}
