"""Power grids, resampling and multiple testing."""

from __future__ import annotations

from splitlane.operators import power, power_tables, resampling
from splitlane.operators.diagnostics import segment_lift
from splitlane.plans.common import (
    EVEN,
    GUARDRAILS,
    SAME_DAY,
    TEST_OUTPUT,
    UNITS,
    Query,
    on_events,
    r,
    tested,
    tested_conversion,
    two_sided_p,
    wide,
    with_tables,
)


def _dealt(salt: str, repeats: int) -> str:
    return f"""
users AS (SELECT user_id, variant, count(*) AS days,
    count(*) FILTER (WHERE converted) AS orders
  FROM units WHERE user_id IS NOT NULL GROUP BY user_id, variant),
dealt AS (SELECT u.user_id, u.variant AS real_variant, u.days, u.orders, replicate,
    md5(u.user_id || ':{salt}' || replicate) AS digest
  FROM users u, range(0, {repeats}) reps(replicate)),
drawn AS (SELECT *, CASE WHEN right(digest, 1) IN {EVEN} THEN 'treatment' ELSE 'control'
    END AS variant, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS first_draw,
    CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS second_draw FROM dealt)"""


CELLS = (
    UNITS
    + ","
    + _dealt("replicate", 20)
    + """,
rate AS (SELECT avg(CASE WHEN converted THEN 1::DOUBLE ELSE 0 END) AS p FROM units),
cells AS (
  SELECT replicate, variant, sample_pct, uplift,
    CAST(sum(CASE WHEN first_draw < floor(sample_pct / 100 * 4294967296) THEN days ELSE 0
      END) AS BIGINT) AS adders,
    CAST(sum(CASE WHEN first_draw >= floor(sample_pct / 100 * 4294967296) THEN 0
      WHEN variant = 'treatment' AND second_draw
        < floor(least(p * uplift / (1 - p), 1) * 4294967296) THEN days
      ELSE orders END) AS BIGINT) AS orders
  FROM drawn, rate, (VALUES (25), (50), (100)) sizes(sample_pct),
    (VALUES (0::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE), (0.03::DOUBLE)) lifts(uplift)
  GROUP BY ALL)"""
)

POWER = (
    CELLS
    + ","
    + tested_conversion("cells", "replicate, sample_pct, uplift")
    + """,
power AS (
  SELECT CAST(floor((SELECT count(*) / count(DISTINCT date) FROM units) * sample_pct
      / 100::DOUBLE) AS BIGINT) AS users_per_day,
    CAST(floor((SELECT count(DISTINCT user_id) FROM units) * sample_pct / 100::DOUBLE)
      AS BIGINT) AS users_tested,
    uplift, CAST(20 AS BIGINT) AS repeats, count(*) FILTER (WHERE p_value < 0.05) AS detections,
    count(*) FILTER (WHERE p_value < 0.05) / 20::DOUBLE AS detection_rate, 0.05::DOUBLE AS alpha
  FROM tested GROUP BY sample_pct, uplift)"""
)

GRID_COLUMNS = (
    f"users_per_day, users_tested, {r('uplift')}, repeats, detections, {r('detection_rate')}, {r('alpha')}"
)


def _on_grid(table):
    return on_events(lambda events: table(power.detection_grid(events)))


SEGMENTS = (
    UNITS
    + """,
segment_cells AS (
  SELECT CASE WHEN u.date = f.first_day THEN 'new' ELSE 'returning' END AS segment,
    u.variant, count(*) AS adders, count(*) FILTER (WHERE converted) AS orders
  FROM units u JOIN (SELECT user_id, min(date) AS first_day FROM add_to_cart GROUP BY 1) f
    ON u.user_id = f.user_id GROUP BY 1, 2)"""
    + ","
    + tested_conversion("segment_cells", "segment")
)

# A 32-bit draw from here on means at least 1, 2, 3, ... copies.
POISSON = " + ".join(
    f"CAST(first_draw >= {least} AS INTEGER)"
    for least in (
        1580030168,
        3160060337,
        3950075421,
        4213413783,
        4279248373,
        4292415291,
        4294609777,
        4294923276,
        4294962463,
        4294966817,
        4294967252,
        4294967292,
        4294967295,
    )
)

AUTH_TESTS = wide("guardrails", "auth_pair", "date", ["authorized", "total_attempts"])

P_ADJUST_SQL = f"""
WITH tests AS (
  SELECT 'ccr' AS family, CAST(date AS VARCHAR) AS test, p_value FROM (
    {with_tables(SAME_DAY, tested_conversion('same_day', 'date'),
                 select='SELECT date, p_value FROM tested')})
  UNION ALL
  SELECT 'payment_auth', CAST(date AS VARCHAR), p_value FROM (
    {with_tables(GUARDRAILS, AUTH_TESTS, tested('auth_pair', 'control_authorized',
                 'control_total_attempts', 'treatment_authorized',
                 'treatment_total_attempts'), select='SELECT date, p_value FROM tested')})),
ranked AS (SELECT *, count(*) OVER (PARTITION BY family) AS m,
    row_number() OVER (PARTITION BY family ORDER BY p_value, test) AS i
  FROM tests WHERE p_value IS NOT NULL)
SELECT family, test, {r('p_value')}, {r('least(1, p_value * m)', 'bonferroni')},
  {r('''least(1, max(p_value * (m - i + 1)) OVER (PARTITION BY family ORDER BY i))''', 'holm')},
  {r('''least(1, min(p_value * m / i) OVER (PARTITION BY family ORDER BY i DESC))''',
     'benjamini_hochberg')} FROM ranked
UNION ALL SELECT family, test, NULL, NULL, NULL, NULL FROM tests WHERE p_value IS NULL"""

INTERACTION = """
gaps AS (
  SELECT max(effect_abs) FILTER (WHERE segment = 'new') AS effect_first,
    max(effect_abs) FILTER (WHERE segment = 'returning') AS effect_second,
    sum(se_split * se_split) AS variance FROM tested WHERE segment IN ('new', 'returning')),
measured AS (SELECT *, effect_second - effect_first AS difference,
  (effect_second - effect_first) / nullif(sqrt(variance), 0) AS z FROM gaps)"""

QUERIES: dict[str, Query] = {
    "grid_points": Query(
        on_events(power.grid_points),
        with_tables(
            CELLS,
            wide("cells", "paired", "replicate, sample_pct, uplift", ["adders"]),
            select=f"""
SELECT CAST(sample_pct AS BIGINT) AS sample_pct, {r('uplift')}, replicate, 'replicate' || replicate AS salt,
  coalesce(control_adders, 0) AS control_adders,
  coalesce(treatment_adders, 0) AS treatment_adders FROM paired""",
        ),
    ),
    "detection_grid": Query(
        on_events(power.detection_grid),
        with_tables(POWER, select=f"SELECT {GRID_COLUMNS} FROM power"),
    ),
    "power_table": Query(
        _on_grid(power_tables.power_table),
        with_tables(
            POWER,
            select=f"""
SELECT users_per_day, users_tested, {r('uplift * 100', 'uplift_pct')},
  {r('detection_rate * 100', 'detection_rate_pct')}, detections, repeats,
  {r('alpha * 100', 'alpha_pct')} FROM power""",
        ),
    ),
    "power_near_mde": Query(
        _on_grid(power_tables.power_near_mde),
        with_tables(
            POWER,
            select=f"""
SELECT {GRID_COLUMNS}, abs(uplift - 0.015::DOUBLE) <= 0.005::DOUBLE AS near_mde
FROM power WHERE uplift > 0
ORDER BY near_mde DESC, CASE WHEN near_mde THEN -detection_rate
  ELSE abs(uplift - 0.015::DOUBLE) END, users_per_day, power.uplift LIMIT 1""",
        ),
    ),
    "power_best_by_uplift": Query(
        _on_grid(power_tables.power_best_by_uplift),
        with_tables(
            POWER,
            select=f"""
SELECT {GRID_COLUMNS} FROM power WHERE uplift > 0
QUALIFY row_number() OVER (PARTITION BY power.uplift
  ORDER BY power.detection_rate DESC, users_per_day) = 1""",
        ),
    ),
    "power_curve": Query(
        _on_grid(power_tables.power_curve),
        with_tables(
            POWER,
            select=f"""
SELECT {r('uplift * 100', 'uplift_pct')},
  max(detection_rate) FILTER (WHERE users_per_day = (SELECT min(users_per_day) FROM power))
    AS smallest,
  max(detection_rate) FILTER (WHERE users_per_day = (SELECT max(users_per_day) FROM power))
    AS largest
FROM power WHERE uplift > 0 GROUP BY power.uplift""",
        ),
    ),
    "power_grid_shape": Query(
        _on_grid(power_tables.power_grid_shape),
        with_tables(
            POWER,
            select="""
SELECT count(*) AS grid_points, count(DISTINCT users_per_day) AS sample_sizes,
  count(DISTINCT uplift) AS uplifts, CAST(sum(repeats) AS BIGINT) AS total_runs FROM power""",
        ),
    ),
    "sample_size_table": Query(
        _on_grid(power_tables.sample_size_table),
        with_tables(
            POWER,
            select=f"""
SELECT {r('uplift')}, target_pct, count(*) FILTER (WHERE detection_rate >= target_pct / 100) > 0
    AS reached, coalesce(min(users_tested) FILTER (WHERE detection_rate >= target_pct / 100),
    max(users_tested)) AS users_tested
FROM power, (VALUES (50::BIGINT), (80::BIGINT), (95::BIGINT)) targets(target_pct)
GROUP BY power.uplift, target_pct""",
        ),
    ),
    "aa_false_positive_rate": Query(
        _on_grid(power_tables.false_positive_rate),
        with_tables(
            POWER,
            select=f"""
SELECT users_per_day, users_tested, repeats, detections, {r('detection_rate')}, {r('alpha')}
FROM power WHERE uplift = 0""",
        ),
    ),
    "bootstrap_ci": Query(
        on_events(resampling.bootstrap_ci),
        with_tables(
            UNITS,
            _dealt("bootstrap", 100),
            f"""
weighted AS (SELECT replicate, real_variant, days, orders, {POISSON} AS weight FROM drawn),
effects AS (
  SELECT replicate,
    sum(weight * orders) FILTER (WHERE real_variant = 'treatment')
      / sum(weight * days) FILTER (WHERE real_variant = 'treatment')
    - sum(weight * orders) FILTER (WHERE real_variant = 'control')
      / sum(weight * days) FILTER (WHERE real_variant = 'control') AS effect
  FROM weighted GROUP BY replicate)""",
            select=f"""
SELECT count(effect) AS replicates, {r('avg(effect)', 'effect_mean')},
  {r('stddev_samp(effect)', 'effect_std')}, {r('quantile_cont(effect, 0.025)', 'ci_low')},
  {r('quantile_cont(effect, 0.975)', 'ci_high')} FROM effects""",
        ),
    ),
    "permutation_test": Query(
        on_events(resampling.permutation_test),
        with_tables(
            UNITS,
            _dealt("permute", 100),
            """
effects AS (
  SELECT replicate, sum(orders) FILTER (WHERE variant = 'treatment')
      / sum(days) FILTER (WHERE variant = 'treatment')
    - sum(orders) FILTER (WHERE variant = 'control')
      / sum(days) FILTER (WHERE variant = 'control') AS effect
  FROM drawn GROUP BY replicate),
real_effect AS (
  SELECT avg(CAST(converted AS INTEGER)) FILTER (WHERE variant = 'treatment')
    - avg(CAST(converted AS INTEGER)) FILTER (WHERE variant = 'control') AS observed
  FROM units)""",
            select=f"""
SELECT {r('observed')}, count(*) AS replicates,
  count(*) FILTER (WHERE abs(effect) >= abs(observed)) AS as_extreme,
  {r('(count(*) FILTER (WHERE abs(effect) >= abs(observed)) + 1) / (count(*) + 1)', 'p_value')}
FROM effects, real_effect WHERE effect IS NOT NULL GROUP BY real_effect.observed""",
        ),
    ),
    "p_adjust": Query(on_events(resampling.p_adjust), P_ADJUST_SQL),
    "segment_lift": Query(
        on_events(segment_lift),
        with_tables(
            SEGMENTS,
            select=f"""
SELECT segment, control_adders, control_orders, treatment_adders, treatment_orders,
  {TEST_OUTPUT} FROM tested""",
        ),
    ),
    "interaction_test": Query(
        on_events(
            lambda events: resampling.interaction_test(
                segment_lift(events), "segment", "new", "returning"
            )
        ),
        with_tables(
            SEGMENTS,
            INTERACTION,
            select=f"""
SELECT {r('effect_first')}, {r('effect_second')}, {r('difference')}, {r('z')},
  {r(two_sided_p('z'), 'p_value')} FROM measured""",
        ),
    ),
}
