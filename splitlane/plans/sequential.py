"""Early stopping: interim looks and how often each rule errs."""

from __future__ import annotations

from splitlane.functions.sequential import equal_looks, spending_boundaries
from splitlane.operators import sequential
from splitlane.plans.common import EVEN, UNITS, Query, day, on_events, r, tested, wide, with_tables

# The critical values are parameters of the plan, the same in both forms; a test holds them
# against published tables and simulated paths.
_PLAN = list(
    zip(
        range(1, sequential.LOOKS + 1),
        *[spending_boundaries(equal_looks(sequential.LOOKS), 0.05, rule) for rule in ("obrien_fleming", "pocock")],
        strict=True,
    )
)
PLAN = "\nplan(look, obrien_fleming, pocock) AS (VALUES " + ", ".join(
    f"({k}, '{a!r}'::DOUBLE, '{b!r}'::DOUBLE)" for k, a, b in _PLAN
) + ")"

FIRST_DAYS = """
firsts AS (SELECT user_id, variant, min(date) AS joined,
    min(CASE WHEN converted THEN date END) AS bought
  FROM units WHERE user_id IS NOT NULL GROUP BY user_id, variant)"""

REDEALT = f"""
people AS (SELECT user_id, min(joined) AS joined, min(bought) AS bought FROM firsts GROUP BY user_id),
cast_out AS (SELECT replicate, joined, bought,
    CASE WHEN right(md5(user_id || ':looks' || replicate), 1) IN {EVEN}
      THEN 'treatment' ELSE 'control' END AS variant
  FROM people, range(0, 100) reps(replicate))"""


def _totals(source: str, key: str) -> str:
    """Running totals per look of every ``key``."""
    measures = [f"{v}_{m}" for v in ("control", "treatment") for m in ("adders", "orders")]
    sums = ", ".join(
        f"CAST(sum(coalesce({m}, 0)) OVER (PARTITION BY {key} ORDER BY date) AS BIGINT) AS {m}" for m in measures
    )
    return (
        f"""
steps AS (SELECT {key} AS {key}, variant, joined AS date, 1 AS adders, 0 AS orders FROM {source}
  UNION ALL SELECT {key}, variant, bought, 0, 1 FROM {source} WHERE bought IS NOT NULL),
fresh AS (SELECT {key}, variant, date, sum(adders) AS adders, sum(orders) AS orders
  FROM steps GROUP BY ALL),"""
        + wide("fresh", "fresh_pair", f"{key}, date", ["adders", "orders"])
        + f""",
totals AS (SELECT {key}, date, row_number() OVER (PARTITION BY {key} ORDER BY date) AS look, {sums}
  FROM fresh_pair),"""
        + tested("totals", "control_orders", "control_adders", "treatment_orders", "treatment_adders")
        + f""",
varied AS (SELECT *, p_all * (1 - p_all) * (1 / control_adders + 1 / treatment_adders) AS v FROM tested),
mixed AS (SELECT *, CASE WHEN v > 0 THEN least(1, sqrt((v + 0.0004) / v)
    * exp(-0.0004 * effect_abs * effect_abs / (2 * v * (v + 0.0004)))) ELSE 1 END AS one FROM varied),
seen AS (SELECT *, min(coalesce(one, 1)) OVER (PARTITION BY {key} ORDER BY look) AS always_valid_p
  FROM mixed)"""
    )


QUERIES = {
    "interim_looks": Query(
        on_events(sequential.interim_looks),
        with_tables(
            UNITS,
            FIRST_DAYS,
            "\nreal AS (SELECT 0 AS replicate, * FROM firsts)",
            _totals("real", "replicate"),
            PLAN,
            """
judged AS (SELECT s.*, obrien_fleming, pocock,
    coalesce(always_valid_p <= 0.05, false) AS stop_v,
    coalesce(abs(z) >= obrien_fleming, false) AS stop_o, coalesce(abs(z) >= pocock, false) AS stop_p
  FROM seen s LEFT JOIN plan USING (look))""",
            select=f"""
SELECT {day()}, look, control_adders, control_orders, treatment_adders, treatment_orders,
  {r('effect_abs')}, {r('z')}, {r('p_value')}, {r('always_valid_p')},
  {r('obrien_fleming', 'boundary_obrien_fleming')}, {r('pocock', 'boundary_pocock')},
  stop_v AS stop_always_valid, bool_or(stop_v) OVER (ORDER BY look) AS stopped_always_valid,
  stop_o AS stop_obrien_fleming, bool_or(stop_o) OVER (ORDER BY look) AS stopped_obrien_fleming,
  stop_p AS stop_pocock, bool_or(stop_p) OVER (ORDER BY look) AS stopped_pocock
FROM judged""",
        ),
    ),
    "early_stopping_errors": Query(
        on_events(sequential.early_stopping_errors),
        with_tables(
            UNITS,
            FIRST_DAYS,
            REDEALT,
            _totals("cast_out", "replicate"),
            PLAN,
            f"""
ever AS (SELECT replicate, max(look) AS looks, bool_or(p_value < 0.05) AS every_look,
    bool_or(always_valid_p <= 0.05) AS always_valid, bool_or(abs(z) >= plan.obrien_fleming) AS obrien_fleming,
    bool_or(abs(z) >= plan.pocock) AS pocock
  FROM seen JOIN plan USING (look) GROUP BY replicate),
named AS (
{" UNION ALL ".join(
    f"SELECT '{rule}' AS rule, max(looks) AS looks, count(*) FILTER (WHERE {rule}) AS false_stops FROM ever"
    for rule in ("every_look", "always_valid", "obrien_fleming", "pocock")
)})""",
            select=f"""
SELECT rule, CAST(100 AS BIGINT) AS repeats, looks, false_stops,
  {r('false_stops / 100', 'false_positive_rate')} FROM named""",
        ),
    ),
}
