"""Excluded traffic, and errors against abandonment."""

from __future__ import annotations

from splitlane.operators import exclusions
from splitlane.operators.metrics import guardrails_daily
from splitlane.plans.common import Query, day, on_events, r, with_tables

EXCLUDED = """
excluded AS (SELECT user_id, string_agg(DISTINCT reason, ', ' ORDER BY reason) AS reason FROM (
  SELECT user_id, 'bot' AS reason FROM add_to_cart GROUP BY user_id, date_trunc('hour', "timestamp") HAVING count(*) >= 2
  UNION ALL SELECT user_id, 'staff' FROM (SELECT user_id FROM add_to_cart UNION SELECT user_id FROM begin_checkout
    UNION SELECT user_id FROM order_completed) WHERE user_id LIKE '%7') GROUP BY user_id),
gone AS (SELECT DISTINCT checkout_id FROM (SELECT checkout_id, user_id FROM begin_checkout
    UNION ALL SELECT checkout_id, user_id FROM order_completed) WHERE user_id IN (SELECT user_id FROM excluded))"""

_BY_USER = "user_id IN (SELECT user_id FROM excluded)"
_BY_CHECKOUT = "checkout_id IN (SELECT checkout_id FROM gone)"
_LOST = {
    "add_to_cart": _BY_USER,
    "begin_checkout": f"({_BY_USER} OR {_BY_CHECKOUT})",
    "checkout_step_view": _BY_CHECKOUT,
    "form_error": _BY_CHECKOUT,
    "payment_attempt": _BY_CHECKOUT,
    "order_completed": f"({_BY_USER} OR {_BY_CHECKOUT})",
}


def _kept_guardrails(events):
    return guardrails_daily(exclusions.without_users(events, exclusions.preset_exclusions(events))).drop("missing")


QUERIES = {
    "excluded_users": Query(
        on_events(exclusions.preset_exclusions), with_tables(EXCLUDED, select="SELECT user_id, reason FROM excluded")
    ),
    "exclusion_counts": Query(
        on_events(lambda events: exclusions.exclusion_counts(events, exclusions.preset_exclusions(events))),
        with_tables(
            EXCLUDED,
            select=" UNION ALL ".join(
                f"SELECT '{name}' AS table_name, count(*) AS rows, count(*) FILTER (WHERE NOT {lost}) AS kept,"
                f" count(*) FILTER (WHERE {lost}) AS excluded FROM {name}"
                for name, lost in _LOST.items()
            ),
        ),
    ),
    "guardrails_without_excluded": Query(
        on_events(_kept_guardrails),
        with_tables(
            EXCLUDED,
            f"""
paid AS (SELECT * FROM payment_attempt WHERE NOT {_LOST['payment_attempt']}),
sold AS (SELECT * FROM order_completed WHERE NOT {_LOST['order_completed']}),
cells AS (SELECT CAST("timestamp" AS DATE) AS date, variant, count(*) AS total_attempts,
    count(*) FILTER (WHERE authorized) AS authorized, 0 AS order_count, NULL::DOUBLE AS aov FROM paid GROUP BY 1, 2
  UNION ALL SELECT CAST("timestamp" AS DATE), variant, 0, 0, count(*), avg(order_value) FROM sold GROUP BY 1, 2),
joined AS (SELECT date, variant, CAST(sum(total_attempts) AS BIGINT) AS total_attempts,
    CAST(sum(authorized) AS BIGINT) AS authorized, CAST(sum(order_count) AS BIGINT) AS order_count, max(aov) AS aov
  FROM cells GROUP BY 1, 2)""",
            select=f"""
SELECT {day()}, variant, total_attempts, authorized, {r('authorized / nullif(total_attempts, 0)', 'auth_rate')},
  order_count, {r('aov')} FROM joined""",
        ),
    ),
    "error_abandonment": Query(
        on_events(exclusions.error_abandonment),
        with_tables(
            """
counted AS (SELECT checkout_id, variant FROM begin_checkout UNION SELECT checkout_id, variant FROM form_error),
facts AS (SELECT variant, (checkout_id, variant) IN (SELECT (checkout_id, variant) FROM form_error) AS failed,
    (checkout_id, variant) IN (SELECT (checkout_id, variant) FROM order_completed) AS bought FROM counted),
cells AS (SELECT coalesce(variant, 'both') AS variant, count(*) FILTER (WHERE failed AND NOT bought)::DOUBLE AS a,
    count(*) FILTER (WHERE failed AND bought)::DOUBLE AS b, count(*) FILTER (WHERE NOT failed AND NOT bought)::DOUBLE AS c,
    count(*) FILTER (WHERE NOT failed AND bought)::DOUBLE AS d
  FROM facts GROUP BY GROUPING SETS ((variant), ())),
shifted AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5::DOUBLE ELSE 0 END AS h FROM cells),
logs AS (SELECT *, ln((a + h) * (d + h) / ((b + h) * (c + h))) AS l,
    sqrt(1 / (a + h) + 1 / (b + h) + 1 / (c + h) + 1 / (d + h)) AS e FROM shifted)""",
            select=f"""
SELECT variant, CAST(a + b AS BIGINT) AS with_errors, CAST(c + d AS BIGINT) AS without_errors,
  {r('a / nullif(a + b, 0)', 'abandoned_with')}, {r('c / nullif(c + d, 0)', 'abandoned_without')},
  {r('exp(l)', 'odds_ratio')}, {r('exp(l - 1.96::DOUBLE * e)', 'ci_low')}, {r('exp(l + 1.96::DOUBLE * e)', 'ci_high')},
  {r('l / e', 'z')}, {r('(a * d - b * c) / nullif(sqrt((a + b) * (c + d) * (a + c) * (b + d)), 0)', 'phi')}
FROM logs""",
        ),
    ),
}
