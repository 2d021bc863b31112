"""Sequences of errors."""

from __future__ import annotations

from splitlane.operators import sequences
from splitlane.plans.common import Query, on_events, r, with_tables

QUERIES = {
    "error_patterns": Query(
        on_events(sequences.error_patterns),
        with_tables(
            """
placed AS (SELECT checkout_id, variant, step_name || '/' || error_code AS item,
    row_number() OVER (PARTITION BY checkout_id ORDER BY "timestamp", step_name || '/' || error_code) AS i
  FROM form_error),
total AS (SELECT count(DISTINCT checkout_id) AS n FROM form_error),
found AS (
  SELECT DISTINCT checkout_id, variant, [item] AS items FROM placed
  UNION ALL SELECT DISTINCT a.checkout_id, a.variant, [a.item, b.item]
    FROM placed a JOIN placed b ON a.checkout_id = b.checkout_id AND a.i < b.i
  UNION ALL SELECT DISTINCT a.checkout_id, a.variant, [a.item, b.item, c.item]
    FROM placed a JOIN placed b ON a.checkout_id = b.checkout_id AND a.i < b.i
    JOIN placed c ON b.checkout_id = c.checkout_id AND b.i < c.i),
counted AS (SELECT items, count(*) AS support, count(*) FILTER (WHERE variant = 'control') AS control_support,
    count(*) FILTER (WHERE variant = 'treatment') AS treatment_support FROM found GROUP BY items)""",
            select=f"""
SELECT array_to_string(items, ' > ') AS pattern, len(items) AS length, support, control_support, treatment_support,
  {r('support / n', 'share')}, len(list_distinct(items)) < len(items) AS repeats
FROM counted, total WHERE support >= greatest(ceil(0.01::DOUBLE * n), 1)""",
        ),
    ),
}
