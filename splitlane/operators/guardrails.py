"""Guardrail rules: how far a treatment metric may move against its baseline."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.functions.formatting import settled
from splitlane.operators.dates import EVENT, day_of
from splitlane.operators.metrics import guardrails_daily
from splitlane.operators.quality import side_by_side
from splitlane.sources.contract import EventTables

# Rule keys and the preset thresholds. pp rules compare in the metric's
# own unit, so rates must be passed as percentages.
RULE_TYPES = (
    "max_drop_pp",
    "max_drop_pct",
    "max_increase_pp",
    "max_increase_ms",
    "max_increase_pct",
)
PRESET_RULES: dict[str, dict[str, float]] = {
    "payment_auth_rate": {"max_drop_pp": 0.3},
    "aov": {"max_drop_pct": 1.0},
    "payment_latency_p95": {"max_increase_ms": 150.0},
}


def read_rule(rule: Mapping[str, float]) -> tuple[str, float]:
    """The rule type and threshold of a rule mapping; the last known key wins."""
    found = None
    for key, threshold in rule.items():
        kind = next((kind for kind in RULE_TYPES if key.startswith(kind)), None)
        if kind:
            found = (kind, float(threshold))
    if found is None:
        raise ValueError(f"no known guardrail rule in {dict(rule)!r}")
    return found


def rule_of(metric: Column, rules: Mapping[str, Mapping[str, float]]) -> Column:
    """The rule of a metric as ``struct<rule_type, threshold>``; NULL without one.

    Rules are a handful of literals, so they are looked up in a constant map.
    """
    entries: list[Column] = []
    for name, rule in rules.items():
        rule_type, threshold = read_rule(rule)
        entries += [
            F.lit(name),
            F.struct(
                F.lit(rule_type).alias("rule_type"), F.lit(threshold).alias("threshold")
            ),
        ]
    return F.try_element_at(F.create_map(*entries), metric)


def guardrail_delta(base: Column, treated: Column, rule_type: Column) -> Column:
    """Movement in the harmful direction; NULL for a percentage of a zero baseline."""
    drop = rule_type.startswith("max_drop")
    harm = F.when(drop, base - treated).otherwise(treated - base)
    relative = rule_type.endswith("_pct")
    return F.when(relative, F.try_divide(harm, base) * 100.0).otherwise(harm)


def evaluate(
    metrics: DataFrame, rules: Mapping[str, Mapping[str, float]] = PRESET_RULES
) -> DataFrame:
    """Judge ``metric, baseline, treatment`` rows; metrics without a rule are left out."""
    base, treated = F.col("baseline"), F.col("treatment")
    known = base.isNotNull() & treated.isNotNull()
    ruled = (
        metrics.withColumn("_rule", rule_of(F.col("metric"), rules))
        .where(F.col("_rule").isNotNull())
        .select("*", "_rule.rule_type", "_rule.threshold")
        .drop("_rule")
    )
    return (
        ruled.withColumn("delta", guardrail_delta(base, treated, F.col("rule_type")))
        .withColumn(
            "passed",
            F.coalesce(known & (F.col("delta") <= F.col("threshold")), F.lit(False)),
        )
        .withColumn("message", _message())
    )


def _message() -> Column:
    kind = F.col("rule_type")
    word = F.when(kind.startswith("max_drop"), "drop").otherwise("increase")
    unit = (
        F.when(kind.endswith("_pct"), "%").when(kind.endswith("_ms"), "ms").otherwise("pp")
    )
    verdict = F.when(F.col("passed"), "pass").otherwise("fail")
    told = F.concat(
        word,
        F.lit(" of "),
        F.format_string("%.3f", settled(F.col("delta"), 3)),
        unit,
        F.lit(" against a limit of "),
        F.format_string("%.3f", settled(F.col("threshold"), 3)),
        unit,
        F.lit(": "),
        verdict,
    )
    return F.when(F.col("delta").isNotNull(), told).otherwise(
        "no baseline to compare with: fail"
    )


def daily_metric_rows(events: EventTables) -> DataFrame:
    """``date, metric, baseline, treatment`` for the two order guardrails, rates × 100."""
    wide = side_by_side(guardrails_daily(events), ["date"], ["auth_rate", "aov"])
    return wide.select(
        "date",
        F.inline(
            F.array(
                F.struct(
                    F.lit("payment_auth_rate").alias("metric"),
                    (F.col("control_auth_rate") * 100.0).alias("baseline"),
                    (F.col("treatment_auth_rate") * 100.0).alias("treatment"),
                ),
                F.struct(
                    F.lit("aov").alias("metric"),
                    F.col("control_aov").alias("baseline"),
                    F.col("treatment_aov").alias("treatment"),
                ),
            )
        ),
    )


def guardrail_eval(
    events: EventTables, rules: Mapping[str, Mapping[str, float]] = PRESET_RULES
) -> DataFrame:
    return evaluate(daily_metric_rows(events), rules)


TOTAL = "total"


def scoped(df: DataFrame, day: Column, *aggs: Column) -> DataFrame:
    """Aggregates per ``scope, variant``: every day as text, and the whole window."""
    scope, variant = F.col("scope"), F.col("variant")
    return (
        df.withColumn("scope", day.cast("string"))
        .groupingSets([[scope, variant], [variant]], scope, variant)
        .agg(F.grouping("scope").alias("_total"), *aggs)
        .withColumn("scope", F.when(F.col("_total") == 1, TOTAL).otherwise(scope))
        .drop("_total")
    )


def scoped_metric_rows(events: EventTables) -> DataFrame:
    """``scope, metric, baseline, treatment``: all preset metrics of days and window.

    Every scope has a row per metric; what has no data in an arm is NULL there.
    Latencies are counted per value first, so a percentile's state stays short.
    """
    payments = scoped(
        events.payment_attempt,
        day_of(EVENT),
        F.try_divide(F.count_if("authorized") * 100.0, F.count(F.lit(1))).alias("value"),
    )
    orders = scoped(
        events.order_completed, day_of(EVENT), F.avg("order_value").alias("value")
    )
    views = events.checkout_step_view.where(F.col("step_name") == "payment")
    frequencies = views.groupBy("date", "variant", "latency_ms").agg(
        F.count(F.lit(1)).alias("_n")
    )
    latencies = scoped(
        frequencies,
        F.col("date"),
        F.percentile(F.col("latency_ms"), F.lit(0.95), F.col("_n")).alias("value"),
    )
    cells = None
    sources = {
        "payment_auth_rate": payments,
        "aov": orders,
        "payment_latency_p95": latencies,
    }
    for metric, source in sources.items():
        part = source.select("scope", "variant", F.lit(metric).alias("metric"), "value")
        cells = part if cells is None else cells.unionByName(part)

    def arm(metric: str, variant: str, name: str) -> Column:
        mine = (F.col("metric") == metric) & (F.col("variant") == variant)
        return F.max(F.when(mine, F.col("value"))).alias(name)

    structs = [
        F.struct(
            F.lit(metric).alias("metric"),
            arm(metric, "control", "baseline"),
            arm(metric, "treatment", "treatment"),
        )
        for metric in sources
    ]
    return (
        cells.groupBy("scope")
        .agg(F.array(*structs).alias("_rows"))
        .select("scope", F.inline("_rows"))
    )
