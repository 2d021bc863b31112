"""What every named query shares: result presentation and the SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlane.functions import normal
from splitlane.functions.formatting import settled
from splitlane.sources.activity_log import read_activity_log
from splitlane.sources.contract import EventTables

PLACES = 6


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def presentable(df: DataFrame) -> DataFrame:
    """Rounded doubles, long integers, and dates and timestamps as text."""

    def shown(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            col = settled(col, PLACES)
        elif isinstance(field.dataType, T.IntegerType):
            col = col.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            col = col.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return col.alias(field.name)

    return df.select(*[shown(field) for field in df.schema.fields])


def on_events(build: Callable[[EventTables], DataFrame]):
    """A query over the event tables derived from the given activity log."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return presentable(build(read_activity_log(spark, sf_dir)))

    return run


# --- SQL -------------------------------------------------------------------------

EVEN = "('0','2','4','6','8','a','c','e')"

EVENT_TABLES = f"""
WITH log AS (
  SELECT event_id, event_type, value, ts AS "timestamp",
    CAST(user_id AS VARCHAR) AS user_id,
    CAST(user_id AS VARCHAR) || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS checkout_id,
    CASE WHEN right(md5(CAST(user_id AS VARCHAR) || ':experiment_v1'), 1) IN {EVEN}
         THEN 'treatment' ELSE 'control' END AS variant,
    CAST(ts AS DATE) AS date,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events),
add_to_cart AS (
  SELECT user_id, checkout_id AS session_id, "timestamp", value AS cart_value,
    k % 10 + 1 AS items_count, variant, date
  FROM log WHERE event_type = 'view'),
begin_checkout AS (
  SELECT user_id, checkout_id, min("timestamp") AS "timestamp", variant, date
  FROM log WHERE event_type = 'click'
  GROUP BY user_id, checkout_id, variant, date),
checkout_step_view AS (
  SELECT checkout_id, ['address','shipping','payment','review'][k % 4 + 1] AS step_name,
    k % 4 AS step_index, "timestamp", variant,
    CAST(floor(value * 20) AS BIGINT) + 200 AS latency_ms, date
  FROM log WHERE event_type = 'signup'),
form_error AS (
  SELECT checkout_id, ['address','shipping','payment','review'][k % 4 + 1] AS step_name,
    'f' || CAST(k % 5 AS VARCHAR) AS field_name,
    ['invalid','declined','timeout'][k % 3 + 1] AS error_code, "timestamp", variant, date
  FROM log WHERE event_type = 'error'),
payment_attempt AS (
  SELECT checkout_id, CASE WHEN k % 2 = 0 THEN 'card' ELSE 'paypal' END AS payment_method,
    k % 10 <> 0 AS authorized, "timestamp", variant, date
  FROM log WHERE event_type = 'purchase'),
order_completed AS (
  SELECT CAST(event_id AS VARCHAR) AS order_id, checkout_id, user_id, "timestamp",
    value AS order_value, 'USD' AS currency, variant, date
  FROM log WHERE event_type = 'purchase' AND k % 10 <> 0)"""

EXPERIMENTS = """
experiments AS (
  SELECT user_id, min(variant) AS variant, min("timestamp") AS first_exposed_at
  FROM add_to_cart GROUP BY user_id)"""

NEWEST = """
newest AS (SELECT max(date) AS day FROM add_to_cart)"""

UNITS = """
units AS (
  SELECT a.date, a.user_id, a.variant, o.user_id IS NOT NULL AS converted
  FROM (SELECT DISTINCT date, user_id, variant FROM add_to_cart) a
  LEFT JOIN (SELECT DISTINCT date, user_id, variant FROM order_completed) o
    ON a.date = o.date AND a.user_id = o.user_id AND a.variant = o.variant)"""

FIRST_EXPOSURE = (
    EXPERIMENTS
    + """,
exposure_cells AS (
  SELECT DISTINCT CAST("timestamp" AS DATE) AS date, variant FROM add_to_cart
  UNION SELECT DISTINCT CAST("timestamp" AS DATE), variant FROM order_completed),
first_exposure AS (
  SELECT c.date, c.variant, coalesce(a.adders, 0) AS adders, coalesce(o.orders, 0) AS orders
  FROM exposure_cells c
  LEFT JOIN (SELECT CAST(first_exposed_at AS DATE) AS date, variant, count(*) AS adders
        FROM experiments GROUP BY 1, 2) a ON c.date = a.date AND c.variant = a.variant
  LEFT JOIN (SELECT CAST("timestamp" AS DATE) AS date, variant,
               count(DISTINCT user_id) AS orders
             FROM order_completed GROUP BY 1, 2) o
    ON c.date = o.date AND c.variant = o.variant)"""
)

GUARDRAILS = """
guard_cells AS (
  SELECT DISTINCT CAST("timestamp" AS DATE) AS date, variant FROM payment_attempt
  UNION SELECT DISTINCT CAST("timestamp" AS DATE), variant FROM order_completed),
guardrails AS (
  SELECT c.date, c.variant, coalesce(p.total_attempts, 0) AS total_attempts,
    coalesce(p.authorized, 0) AS authorized, p.authorized / nullif(p.total_attempts, 0) AS auth_rate,
    coalesce(o.order_count, 0) AS order_count, o.aov,
    nullif(concat_ws(', ', CASE WHEN p.total_attempts IS NULL THEN 'payments' END,
      CASE WHEN o.order_count IS NULL THEN 'orders' END), '') AS missing
  FROM guard_cells c
  LEFT JOIN (SELECT CAST("timestamp" AS DATE) AS date, variant, count(*) AS total_attempts,
          count(*) FILTER (WHERE authorized) AS authorized
        FROM payment_attempt GROUP BY 1, 2) p ON c.date = p.date AND c.variant = p.variant
  LEFT JOIN (SELECT CAST("timestamp" AS DATE) AS date, variant, count(*) AS order_count,
               avg(order_value) AS aov
             FROM order_completed GROUP BY 1, 2) o
    ON c.date = o.date AND c.variant = o.variant)"""


def with_tables(*ctes: str, select: str) -> str:
    return ",".join((EVENT_TABLES, *ctes)) + "\n" + select.strip()


def r(expression: str, name: str | None = None) -> str:
    """A double rounded as the Spark result is."""
    value = f"CAST(({expression}) AS DOUBLE)"
    return f"round({value} + sign({value}) * 1e-9, 6) AS {name or expression}"


def day(expression: str = "date", name: str = "date") -> str:
    return f"CAST({expression} AS VARCHAR) AS {name}"


def moment(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def wide(source: str, name: str, keys: str, measures: list[str]) -> str:
    """Control and treatment rows of ``source`` side by side."""
    picks = ", ".join(
        f"max({m}) FILTER (WHERE variant = '{v}') AS {v}_{m}"
        for v in ("control", "treatment")
        for m in measures
    )
    return f"\n{name} AS (SELECT {keys}, {picks} FROM {source} GROUP BY {keys})"


def _horner(x: str, coefficients) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def two_sided_p(z: str) -> str:
    a = f"abs({z})"
    density = f"exp(-{a} * {a} / 2)"
    top, bottom = (
        _horner(a, c) for c in (normal.TAIL_NUMERATOR, normal.TAIL_DENOMINATOR)
    )
    far = f"({a} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        far = f"({a} + {k} / {far})"
    return (
        f"2 * CASE WHEN {a} < {normal.TAIL_SWITCH!r}::DOUBLE"
        f" THEN {density} * {top} / {bottom}"
        f" WHEN {a} < 37 THEN {density} / {far} / {normal.SQRT_TWO_PI!r}::DOUBLE"
        f" ELSE {a} * 0 END"
    )


def tested(source: str, s_a: str, n_a: str, s_b: str, n_b: str, z: str = "1.96") -> str:
    """A ``tested`` table: every row of ``source`` with its two-proportion test."""

    def reason(s: str, n: str) -> str:
        return (
            f"CASE WHEN {s} IS NULL OR {n} IS NULL THEN 'missing counts'"
            f" WHEN {n} <= 0 THEN 'no observations'"
            f" WHEN {s} < 0 THEN 'negative successes'"
            f" WHEN {s} > {n} THEN 'successes exceed observations' END"
        )

    return f"""
counted AS (SELECT *, coalesce({reason(s_a, n_a)}, {reason(s_b, n_b)}) AS invalid_reason
  FROM {source}),
rated AS (SELECT *,
    CASE WHEN invalid_reason IS NULL THEN {s_a} / {n_a} END AS p_a,
    CASE WHEN invalid_reason IS NULL THEN {s_b} / {n_b} END AS p_b,
    CASE WHEN invalid_reason IS NULL THEN ({s_a} + {s_b}) / ({n_a} + {n_b}) END AS p_all
  FROM counted),
spread AS (SELECT *, p_b - p_a AS effect_abs,
    sqrt(p_all * (1 - p_all) * (1 / {n_a} + 1 / {n_b})) AS se_pooled,
    sqrt(p_a * (1 - p_a) / {n_a} + p_b * (1 - p_b) / {n_b}) AS se_split
  FROM rated),
scored AS (SELECT *,
    CASE WHEN p_a > 0 THEN effect_abs / p_a
         WHEN invalid_reason IS NULL THEN 'inf'::DOUBLE END AS effect_rel,
    CASE WHEN se_pooled > 0 THEN effect_abs / se_pooled
         WHEN invalid_reason IS NULL THEN 0::DOUBLE END AS z,
    effect_abs - {z}::DOUBLE * se_split AS ci_low,
    effect_abs + {z}::DOUBLE * se_split AS ci_high
  FROM spread),
tested AS (SELECT *, {two_sided_p('z')} AS p_value FROM scored)"""


def tested_conversion(source: str, keys: str) -> str:
    filled = ", ".join(
        f"coalesce({v}_{m}, 0) AS {v}_{m}"
        for v in ("control", "treatment")
        for m in ("adders", "orders")
    )
    return (
        wide(source, "paired", keys, ["adders", "orders"])
        + f"""
, filled AS (SELECT * REPLACE ({filled}) FROM paired),"""
        + tested(
            "filled",
            "control_orders",
            "control_adders",
            "treatment_orders",
            "treatment_adders",
        )
    )


SAME_DAY = (
    UNITS
    + """,
same_day AS (
  SELECT date, variant, count(*) AS adders, count(*) FILTER (WHERE converted) AS orders
  FROM units GROUP BY date, variant)"""
)

TEST_OUTPUT = ", ".join(
    [r(c) for c in ("p_a", "p_b", "effect_abs", "effect_rel", "z", "p_value", "ci_low", "ci_high")]
    + ["invalid_reason"]
)
