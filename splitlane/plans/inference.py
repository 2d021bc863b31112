"""Clustered effects, and tests over many segments and arms."""

from __future__ import annotations

from splitlane.functions.kolmogorov import SWITCH
from splitlane.operators import clustered, distributions, segments
from splitlane.plans.common import UNITS, Query, moment, on_events, r, tested_conversion, two_sided_p, wide, with_tables

_MOMENTS = ["clusters", "n_rows", "mean", "variance", "design_effect", "icc", "unclustered_rows"]

CLUSTERED = (
    UNITS
    + """,
measured AS (
  SELECT 'conversion' AS metric, variant, user_id, CAST(converted AS INTEGER)::DOUBLE AS v FROM units
  UNION ALL SELECT 'order_value', variant, user_id, order_value FROM order_completed),
people AS (SELECT metric, variant, user_id, count(*)::DOUBLE AS x, sum(v) AS y, sum(v * v) AS q
  FROM measured WHERE v IS NOT NULL AND variant IS NOT NULL GROUP BY ALL),
moments AS (
  SELECT metric, variant, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(y * y) AS yy,
    sum(x * y) AS xy, sum(q) AS q, sum(y * y / x) AS b
  FROM people WHERE user_id IS NOT NULL GROUP BY ALL),
means AS (SELECT *, y / x AS mean, (yy - 2 * (y / x) * xy + (y / x) * (y / x) * xx) AS e2,
    (q - b) / nullif(x - n, 0) AS msw, (b - y * y / x) / nullif(n - 1, 0) AS msb,
    (x - xx / x) / nullif(n - 1, 0) AS size FROM moments),
estimates AS (SELECT metric, variant, n AS clusters, CAST(x AS BIGINT) AS n_rows, mean,
    n * e2 / nullif((n - 1) * x * x, 0) AS variance,
    n * e2 / nullif((n - 1) * x * x, 0) / nullif((q - x * mean * mean) / nullif((x - 1) * x, 0), 0) AS design_effect,
    (msb - msw) / nullif(msb + (size - 1) * msw, 0) AS icc, CAST(0 AS BIGINT) AS unclustered_rows
  FROM means),"""
    + wide("estimates", "both_arms", "metric", _MOMENTS)
    + """,
gap AS (SELECT *, treatment_mean - control_mean AS effect_abs,
    sqrt(control_variance + treatment_variance) AS std_error FROM both_arms),
scored AS (SELECT *, effect_abs / nullif(std_error, 0) AS z FROM gap)"""
)


def _arms(names: list[str], doubles: tuple[str, ...]) -> str:
    out = []
    for v in ("control", "treatment"):
        for m in names:
            shown = f"{v}_{m.replace('n_rows', 'rows')}"
            out.append(r(f"{v}_{m}", shown) if m in doubles else f"{v}_{m} AS {shown}")
    return ", ".join(out)


def chi_square_tail(x: str, d: str) -> str:
    """Upper tail for whole degrees of freedom, by the terms' gamma functions."""
    half = f"(({d}) % 2) / 2.0::DOUBLE"
    terms = (
        f"list_sum(list_transform(range(0, ({d}) // 2), lambda j:"
        f" exp((j + {half}) * ln({x} / 2) - {x} / 2 - lgamma(j + {half} + 1))))"
    )
    return (
        f"CASE WHEN {x} <= 0 THEN 1 WHEN {d} >= 1 THEN least(1, coalesce({terms}, 0)"
        f" + CASE WHEN ({d}) % 2 = 1 THEN {two_sided_p(f'sqrt({x})')} ELSE 0 END) END"
    )


def kolmogorov_tail(x: str) -> str:
    below = " + ".join(f"exp(-{(2 * k - 1) ** 2} * pi() * pi() / 8 / ({x} * {x}))" for k in range(1, 5))
    beyond = " + ".join(f"({(-1) ** (k - 1)}) * exp(-{2 * k * k} * {x} * {x})" for k in range(1, 5))
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1 WHEN {x} < {SWITCH} THEN 1 - sqrt(2 * pi()) / {x} * ({below})"
        f" ELSE 2 * ({beyond}) END"
    )


SEGMENTED = (
    UNITS
    + """,
first_day AS (SELECT user_id, min(date) AS first FROM units GROUP BY user_id),
segmented AS (
  SELECT 'new_or_returning' AS cut, CASE WHEN date = first THEN 'new' ELSE 'returning' END AS segment, units.*
    FROM units JOIN first_day USING (user_id)
  UNION ALL SELECT 'weekday', CAST(isodow(date) - 1 AS VARCHAR), * FROM units
  UNION ALL SELECT 'day', CAST(date AS VARCHAR), * FROM units)"""
)

ARMS = """
arm_counts AS (SELECT cut, segment, variant AS arm, count(*) AS n FROM segmented GROUP BY ALL)"""

QUERIES = {
    "clustered_effects": Query(
        on_events(clustered.clustered_effects),
        with_tables(
            CLUSTERED,
            select=f"""
SELECT metric, {_arms([m for m in _MOMENTS if m != 'variance'], ('mean', 'design_effect', 'icc'))},
  {r('effect_abs')}, {r('std_error')}, CAST(NULL AS VARCHAR) AS invalid_reason, {r('z')},
  {r('effect_abs - 1.96::DOUBLE * std_error', 'ci_low')}, {r('effect_abs + 1.96::DOUBLE * std_error', 'ci_high')},
  {r(two_sided_p('z'), 'p_value')}
FROM scored""",
        ),
    ),
    "lift_heterogeneity": Query(
        on_events(segments.lift_heterogeneity),
        with_tables(
            SEGMENTED,
            "\ncells AS (SELECT cut, segment, variant, count(*) AS adders, count(*) FILTER (WHERE converted) AS orders"
            " FROM segmented GROUP BY ALL)",
            tested_conversion("cells", "cut, segment"),
            """
weighted AS (SELECT cut, effect_abs AS e,
    1 / nullif(p_a * (1 - p_a) / nullif(control_adders, 0) + p_b * (1 - p_b) / nullif(treatment_adders, 0), 0) AS w
  FROM tested),
pooled AS (SELECT cut, sum(w * e) / sum(w) AS pooled_effect FROM weighted GROUP BY cut),
spread_out AS (SELECT cut, any_value(pooled_effect) AS pooled_effect, count(w) AS segments,
    count(*) FILTER (WHERE w IS NULL) AS left_out, sum(w * (e - pooled_effect) * (e - pooled_effect)) AS qq
  FROM weighted JOIN pooled USING (cut) GROUP BY cut),
judged AS (SELECT *, CASE WHEN segments > 1 THEN qq END AS q, CASE WHEN segments > 1 THEN segments - 1 END AS degrees
  FROM spread_out)""",
            select=f"""
SELECT cut, segments, left_out, {r('pooled_effect')}, {r('q')}, degrees,
  {r(chi_square_tail('q', 'degrees'), 'p_value')}, {r('greatest((q - degrees) / nullif(q, 0), 0)', 'inconsistency')},
  coalesce({chi_square_tail('q', 'degrees')} < 0.05, false) AS differs FROM judged""",
        ),
    ),
    "srm_by_segment": Query(
        on_events(segments.srm_by_segment),
        with_tables(
            SEGMENTED,
            ARMS,
            """
split AS (SELECT cut, segment, sum(n)::DOUBLE AS users, coalesce(sum(n) FILTER (WHERE arm = 'control'), 0) AS c
  FROM arm_counts GROUP BY ALL),
chi AS (SELECT *, 4 * (c - users / 2) * (c - users / 2) / users AS x FROM split)""",
            select=f"""
SELECT cut, segment, CAST(users AS BIGINT) AS users, CAST(0 AS BIGINT) AS unplanned_users, {r('x', 'chi_square')},
  CAST(1 AS BIGINT) AS degrees, {r(chi_square_tail('x', '1'), 'p_value')}, {chi_square_tail('x', '1')} < 0.05 AS mismatch
FROM chi""",
        ),
    ),
    "srm_homogeneity": Query(
        on_events(segments.srm_homogeneity),
        with_tables(
            SEGMENTED,
            ARMS,
            """
margins AS (SELECT cut, count(DISTINCT segment) AS segments, count(DISTINCT arm) AS arms, sum(n) AS users
  FROM arm_counts GROUP BY cut),
by_row AS (SELECT cut, segment, sum(n) AS row_n FROM arm_counts GROUP BY ALL),
by_arm AS (SELECT cut, arm, sum(n) AS arm_n FROM arm_counts GROUP BY ALL),
expected AS (SELECT cut, segment, arm, row_n * arm_n / users AS e
  FROM by_row JOIN by_arm USING (cut) JOIN margins USING (cut)),
chi AS (SELECT cut, sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e) AS x
  FROM expected LEFT JOIN arm_counts USING (cut, segment, arm) GROUP BY cut),
both_sides AS (SELECT *, (segments - 1) * (arms - 1) AS d FROM chi JOIN margins USING (cut))""",
            select=f"""
SELECT cut, segments, arms, CAST(users AS BIGINT) AS users, {r('x', 'chi_square')}, d AS degrees,
  {r(chi_square_tail('x', 'd'), 'p_value')}, coalesce({chi_square_tail('x', 'd')} < 0.05, false) AS mismatch
FROM both_sides""",
        ),
    ),
    "latency_tests": Query(
        on_events(distributions.latency_tests),
        with_tables(
            """
at_value AS (SELECT step_name, latency_ms AS v, count(*) FILTER (WHERE variant = 'control')::DOUBLE AS c,
    count(*) FILTER (WHERE variant = 'treatment')::DOUBLE AS t
  FROM checkout_step_view WHERE latency_ms IS NOT NULL GROUP BY ALL),
running AS (SELECT *, sum(c) OVER upto AS cc, sum(t) OVER upto AS tt,
    sum(c) OVER (PARTITION BY step_name) AS n_c, sum(t) OVER (PARTITION BY step_name) AS n_t
  FROM at_value WINDOW upto AS (PARTITION BY step_name ORDER BY v)),
gaps AS (SELECT *, abs(cc / n_c - tt / n_t) AS gap, round(abs(cc / n_c - tt / n_t), 12) AS shown FROM running),
sums AS (SELECT step_name, max(n_c) AS n_c, max(n_t) AS n_t, sum(t * (cc - c + c / 2)) AS u,
    sum((c + t) * (c + t) * (c + t) - (c + t)) AS ties, max(gap) AS distance
  FROM gaps GROUP BY step_name),
reached AS (SELECT g.step_name, min(v) AS distance_at
  FROM gaps g JOIN (SELECT step_name, max(shown) AS most FROM gaps GROUP BY 1) m
    ON g.step_name = m.step_name AND g.shown = m.most GROUP BY 1),
scored AS (SELECT s.*, distance_at, u / (n_c * n_t) AS superiority, distance * sqrt(n_c * n_t / (n_c + n_t)) AS reach,
    (u - n_c * n_t / 2) / sqrt(n_c * n_t / 12 * (n_c + n_t + 1 - ties / ((n_c + n_t) * (n_c + n_t - 1)))) AS z
  FROM sums s JOIN reached USING (step_name)),
judged AS (SELECT *, """
            + f"{two_sided_p('z')} AS rank_p, {kolmogorov_tail('reach')} AS distance_p FROM scored)",
            select=f"""
SELECT step_name, CAST(n_c AS BIGINT) AS control_rows, CAST(n_t AS BIGINT) AS treatment_rows, {r('distance')},
  distance_at, {r('superiority')}, {r('z')}, {r('rank_p', 'rank_p_value')}, {r('distance_p', 'distance_p_value')},
  least(rank_p, distance_p) < 0.025 AS differs
FROM judged""",
        ),
    ),
    "hourly_changes": Query(
        on_events(distributions.hourly_changes),
        with_tables(
            """
hourly AS (
  SELECT 'latency: ' || step_name AS series, date_trunc('hour', "timestamp") AS h, avg(latency_ms)::DOUBLE AS x
    FROM checkout_step_view GROUP BY ALL
  UNION ALL SELECT 'errors: ' || step_name, date_trunc('hour', "timestamp"), count(*)::DOUBLE FROM form_error GROUP BY ALL),
placed AS (SELECT *, count(*) OVER s AS n, avg(x) OVER s AS mean, x - lag(x) OVER o AS step, lead(h) OVER o AS next_h,
    sum(x) OVER o AS total, row_number() OVER o AS i
  FROM hourly WINDOW s AS (PARTITION BY series), o AS (PARTITION BY series ORDER BY h)),
walk AS (SELECT *, CASE WHEN i < n THEN round(abs(total - i * mean), 6) END AS w FROM placed),
best AS (SELECT series, arg_max(i, (w, -i)) FILTER (WHERE w IS NOT NULL) AS i FROM walk GROUP BY series),
noise AS (SELECT series, sqrt(avg(step * step) / 2) AS noise FROM walk GROUP BY series),
sized AS (SELECT series, max(n) AS points FROM walk GROUP BY series),
found AS (SELECT z.series, points, next_h, total / w.i AS mean_before, (n * mean - total) / (n - w.i) AS mean_after,
    noise, CASE WHEN points > 2 AND noise > 0 THEN abs(total - w.i * mean) / (noise * sqrt(n)) END AS statistic
  FROM sized z JOIN noise s ON z.series = s.series LEFT JOIN best b ON z.series = b.series
  LEFT JOIN walk w ON w.series = b.series AND w.i = b.i),
shown AS (SELECT * REPLACE (CASE WHEN statistic IS NOT NULL THEN next_h END AS next_h,
    CASE WHEN statistic IS NOT NULL THEN mean_before END AS mean_before,
    CASE WHEN statistic IS NOT NULL THEN mean_after END AS mean_after) FROM found)""",
            select=f"""
SELECT series, points, {moment('next_h', 'change_at')}, {r('mean_before')}, {r('mean_after')}, {r('noise')},
  {r('statistic')}, {r(kolmogorov_tail('statistic'), 'p_value')},
  coalesce({kolmogorov_tail('statistic')} < 0.05, false) AS changed
FROM shown""",
        ),
    ),
}
