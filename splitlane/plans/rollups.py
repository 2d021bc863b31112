"""Sketch roll-ups, adjusted lift and the monotone power curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitlane.operators import adjusted, monotone, power, sketches
from splitlane.plans.common import UNITS, Query, on_events, presentable, r, two_sided_p, with_tables
from splitlane.plans.experiments import POWER
from splitlane.sources.activity_log import read_activity_log
from splitlane.sources.sinks import shared_folder


def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches stored by day and read back, against the exact figures of the window."""
    events = read_activity_log(spark, sf_dir)
    folder = shared_folder(spark, "sketches")
    sketches.store_sketches(events, folder)
    return presentable(sketches.rollup_check(events, sketches.read_sketches(spark, folder)))


# Means over all runs of neighbouring sizes; the fit is the largest smallest of them.
FITTED = """
sized AS (SELECT uplift, users_tested, sum(repeats) AS w, sum(detection_rate * repeats) AS s
  FROM power GROUP BY ALL),
spans AS (SELECT a.uplift, a.users_tested AS first, b.users_tested AS last, sum(c.s) / sum(c.w) AS m
  FROM sized a JOIN sized b ON a.uplift = b.uplift AND a.users_tested <= b.users_tested
  JOIN sized c ON c.uplift = a.uplift AND c.users_tested BETWEEN a.users_tested AND b.users_tested
  GROUP BY ALL),
worst AS (SELECT p.uplift, p.users_tested, s.first, min(m) AS m
  FROM sized p JOIN spans s ON s.uplift = p.uplift AND p.users_tested BETWEEN s.first AND s.last GROUP BY ALL),
fitted AS (SELECT p.uplift, p.users_tested, CAST(p.w AS BIGINT) AS repeats, p.s / p.w AS detection_rate,
    max(v.m) AS fitted_rate
  FROM sized p JOIN worst v ON p.uplift = v.uplift AND p.users_tested = v.users_tested GROUP BY ALL)"""

QUERIES = {
    "sketch_rollup": Query(
        sketch_rollup,
        with_tables(
            select="""
SELECT 'adders' AS measure, variant, count(DISTINCT user_id) AS exact, true AS within_error
FROM add_to_cart GROUP BY variant
UNION ALL SELECT 'orderers', variant, count(DISTINCT user_id), true FROM order_completed GROUP BY variant
UNION ALL SELECT 'latency: ' || step_name, variant, count(latency_ms), true
FROM checkout_step_view GROUP BY step_name, variant"""
        ),
    ),
    "adjusted_conversion_lift": Query(
        on_events(
            lambda events: adjusted.adjusted_conversion_lift(events).where("term IN ('treatment', 'segment=returning')").drop("reason")
        ),
        with_tables(
            UNITS,
            """
firsts AS (SELECT user_id, min(date) AS first FROM units GROUP BY user_id),
coded AS (SELECT isodow(date) AS weekday, CASE WHEN variant = 'treatment' THEN 1::DOUBLE ELSE 0 END AS t,
    CASE WHEN date = first THEN 0::DOUBLE ELSE 1 END AS s, CAST(converted AS INTEGER)::DOUBLE AS y
  FROM units JOIN firsts USING (user_id)),
centred AS (SELECT weekday, t - avg(t) OVER w AS t, s - avg(s) OVER w AS s, y - avg(y) OVER w AS y
  FROM coded WINDOW w AS (PARTITION BY weekday)),
sums AS (SELECT count(*) AS n, count(DISTINCT weekday) AS days, sum(t * t) AS tt, sum(s * s) AS ss, sum(t * s) AS ts,
    sum(t * y) AS ty, sum(s * y) AS sy, sum(y * y) AS yy FROM centred),
solved AS (SELECT *, (ss * ty - ts * sy) / (tt * ss - ts * ts) AS bt, (tt * sy - ts * ty) / (tt * ss - ts * ts) AS bs FROM sums),
noisy AS (SELECT *, (yy - bt * ty - bs * sy) / (n - days - 2) AS v FROM solved),
terms AS (SELECT 'treatment' AS term, bt AS estimate, sqrt(v * ss / (tt * ss - ts * ts)) AS std_error, n FROM noisy
  UNION ALL SELECT 'segment=returning', bs, sqrt(v * tt / (tt * ss - ts * ts)), n FROM noisy),
scored AS (SELECT *, estimate / std_error AS z FROM terms)""",
            select=f"""
SELECT term, {r('estimate')}, {r('std_error')}, n AS rows, {r('z')}, {r(two_sided_p('z'), 'p_value')},
  {r('estimate - 1.96::DOUBLE * std_error', 'ci_low')}, {r('estimate + 1.96::DOUBLE * std_error', 'ci_high')}
FROM scored""",
        ),
    ),
    "adjusted_lift_by_weekday": Query(
        on_events(
            lambda events: adjusted.adjusted_lift(
                adjusted.new_or_returning(events).selectExpr(
                    "variant", "cast(converted as double) AS value", "weekday(date) AS weekday"
                ),
                "value",
                ["weekday"],
            )
            .where("term = 'treatment'")
            .select("estimate", "rows")
        ),
        with_tables(
            UNITS,
            """
coded AS (SELECT isodow(date) AS weekday, CASE WHEN variant = 'treatment' THEN 1::DOUBLE ELSE 0 END AS t,
    CAST(converted AS INTEGER)::DOUBLE AS y FROM units),
centred AS (SELECT t - avg(t) OVER (PARTITION BY weekday) AS t, y - avg(y) OVER (PARTITION BY weekday) AS y FROM coded)""",
            select=f"SELECT {r('sum(t * y) / sum(t * t)', 'estimate')}, count(*) AS rows FROM centred",
        ),
    ),
    "monotone_power": Query(
        on_events(lambda events: monotone.monotone_rates(power.detection_grid(events))),
        with_tables(
            POWER,
            FITTED,
            select=f"""
SELECT {r('uplift')}, users_tested, repeats, {r('detection_rate')}, {r('fitted_rate')} FROM fitted""",
        ),
    ),
    "sample_size_for_power": Query(
        on_events(lambda events: monotone.sample_size_for_power(power.detection_grid(events))),
        with_tables(
            POWER,
            FITTED,
            """
wanted AS (SELECT *, fitted_rate < target AS low FROM fitted,
  (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE)) targets(target)),
ends AS (SELECT uplift, target, max(users_tested) FILTER (WHERE low) AS a, min(users_tested) FILTER (WHERE NOT low) AS b,
    max(fitted_rate) FILTER (WHERE low) AS fa, min(fitted_rate) FILTER (WHERE NOT low) AS fb
  FROM wanted GROUP BY ALL)""",
            select=f"""
SELECT {r('uplift')}, {r('target', 'target_power')},
  CAST(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN ceil(a + (target - fa) / (fb - fa) * (b - a) - 1e-9)
    ELSE b END AS BIGINT) AS users_needed, a IS NOT NULL AND b IS NOT NULL AS within_grid
FROM ends""",
        ),
    ),
}
