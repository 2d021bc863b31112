"""Daily guardrail monitoring of payments and orders as they arrive.

Every row that arrives is accounted for: it counts in its day, repeats a row that does, came
after its day had closed, waits in a day still open, or has no time. Counting needs state, one
row per key of an open day; the arrivals beside it need none.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.functions.clock import epoch_seconds
from splitlane.operators.guardrails import PRESET_RULES, evaluate
from splitlane.operators.quality import side_by_side
from splitlane.sources.activity_log import events_from_activity_log
from splitlane.sources.contract import EventTables
from splitlane.sources.sinks import shared_folder

LATENESS = "2 hours"
DAY_SECONDS = 86_400
END_OF_INPUT = 253_370_764_800  # 9999-01-01

STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TOTALS = ("total_attempts", "authorized", "order_count", "order_value")


def _whole_row(df: DataFrame) -> Column:
    """A key that only rows equal in every column share; 64 characters, for the state."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return F.sha2(row, 256)


def outcome_stream(events: EventTables) -> DataFrame:
    """Payments and orders as one stream of ``event_key, timestamp, variant, ...``.

    Payments have no id, so only a row equal in every column is a repeat; so it is for
    orders that lack theirs.
    """
    payments = events.payment_attempt.select(
        F.concat(F.lit("payment|"), _whole_row(events.payment_attempt)).alias("event_key"),
        "timestamp",
        "variant",
        F.lit(1).alias("attempt"),
        F.col("authorized").cast("int").alias("authorized"),
        F.lit(0).alias("ordered"),
        F.lit(0.0).alias("order_value"),
    )
    orders = events.order_completed.select(
        F.coalesce(
            F.concat(F.lit("order|"), F.col("order_id")),
            F.concat(F.lit("order row|"), _whole_row(events.order_completed)),
        ).alias("event_key"),
        "timestamp",
        "variant",
        F.lit(0).alias("attempt"),
        F.lit(0).alias("authorized"),
        F.lit(1).alias("ordered"),
        "order_value",
    )
    # Watermarks need an instant: the wall clock is read as UTC in any session.
    return payments.unionByName(orders).withColumn(
        "timestamp", F.timestamp_seconds(epoch_seconds(F.col("timestamp")))
    )


def _date(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / DAY_SECONDS).cast("int"))


def daily_outcomes(outcomes: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Attempts, authorizations and orders per day and variant; a key counts once in each.

    Of rows with one key the earliest counts. ``counted`` keys and ``repeated`` rows add up
    to the rows that came in time. A day is emitted when no event of it can arrive any
    more; rows are late from then on, and only then.
    """
    parts = ("timestamp", "attempt", "authorized", "ordered", "order_value")
    keyed = (
        outcomes.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day"), "variant", "event_key")
        .agg(F.min(F.struct(*parts)).alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    return (
        keyed.groupBy(F.window("window", "1 day").alias("day"), "variant")
        .agg(
            F.sum("first.attempt").alias("total_attempts"),
            F.sum("first.authorized").alias("authorized"),
            F.sum("first.ordered").alias("order_count"),
            F.sum("first.order_value").alias("order_value"),
            F.count(F.lit(1)).alias("counted"),
            F.sum(F.col("copies") - 1).alias("repeated"),
        )
        .select(_date(F.col("day.start")).alias("date"), "variant", *TOTALS, "counted", "repeated")
    )


def closed_days_and_arrivals(outcomes: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One stream of two kinds of rows: days that close, and every row that arrives."""
    closed = daily_outcomes(outcomes, lateness).withColumns(
        {"closed": F.lit(True), "rows": F.lit(0).cast("long"), "newest": F.lit(None).cast("timestamp")}
    )
    known = {
        "date": _date(F.col("timestamp")),
        "variant": F.col("variant"),
        "closed": F.lit(False),
        "rows": F.lit(1),
        "newest": F.col("timestamp"),
    }
    arrived = outcomes.select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in closed.schema.fields]
    )
    return closed.unionByName(arrived)


def judge_days(
    days: DataFrame, rules: Mapping[str, Mapping[str, float]] = PRESET_RULES
) -> DataFrame:
    """Guardrail verdicts for closed days; both variants of a day close together."""
    rated = days.withColumns(
        {
            "auth_rate": F.try_divide(F.col("authorized"), F.col("total_attempts")) * 100.0,
            "aov": F.try_divide(F.col("order_value"), F.col("order_count")),
        }
    )
    wide = side_by_side(rated, ["date"], ["auth_rate", "aov"])
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(f"control_{column}").alias("baseline"),
            F.col(f"treatment_{column}").alias("treatment"),
        )
        for metric, column in (("payment_auth_rate", "auth_rate"), ("aov", "aov"))
    ]
    return evaluate(wide.select("date", F.inline(F.array(*rows))), rules)


def end_marker(outcomes: DataFrame) -> DataFrame:
    """One outcome beyond every real day: once seen, all real days can close."""
    spark = outcomes.sparkSession
    known = {
        "event_key": F.lit("end of input"),
        "timestamp": F.timestamp_seconds(F.lit(END_OF_INPUT)),
    }
    return spark.range(1).select(
        *[
            known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in outcomes.schema.fields
        ]
    )


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, unless the session names a store."""
    if spark.conf.get(STORE_SETTING, "").endswith(".HDFSBackedStateStoreProvider"):
        default = spark.conf.get(STORE_SETTING)
        spark.conf.set(STORE_SETTING, ON_DISK)
        try:
            yield
        finally:
            spark.conf.set(STORE_SETTING, default)
    else:
        yield


def run_monitor(
    outcomes: DataFrame,
    out: str,
    checkpoint: str,
    lateness: str = LATENESS,
    final: bool = False,
):
    """Process what has arrived so far; write closed days, their verdicts and all arrivals.

    Each micro-batch overwrites its own folder, so a batch repeated after a failure
    replaces its first try. ``final`` ends a bounded input: after all of it, a marker
    goes in by a second source and closes the days still open. What arrives later is
    late. ``accounted`` says what became of every row.
    """
    spark, ends = outcomes.sparkSession, f"{out}/end"
    marker = end_marker(outcomes)
    marker.limit(0).write.mode("ignore").parquet(ends)

    def save(batch: DataFrame, batch_id: int) -> None:
        # One pass over the batch: a closed day is one row, arrivals become a count per day.
        sums = [F.sum(c).alias(c) for c in (*TOTALS, "counted", "repeated", "rows")]
        log = batch.groupBy("closed", "date", "variant").agg(*sums, F.max("newest").alias("newest"))
        log.write.mode("overwrite").parquet(f"{out}/log/batch={batch_id}")
        written = batch.sparkSession.read.schema(log.schema).parquet(f"{out}/log/batch={batch_id}")
        days = written.where("closed").select("date", "variant", *TOTALS, "counted", "repeated")
        days.write.mode("overwrite").parquet(f"{out}/days/batch={batch_id}")
        arrivals = written.where("not closed").select("date", "variant", "rows", "newest")
        arrivals.write.mode("overwrite").parquet(f"{out}/arrivals/batch={batch_id}")
        judge_days(days).write.mode("overwrite").parquet(f"{out}/verdicts/batch={batch_id}")

    def drain():
        arrived = outcomes.unionByName(
            spark.readStream.schema(outcomes.schema).parquet(ends)
        )
        with state_on_disk(spark):
            query = (
                closed_days_and_arrivals(arrived, lateness)
                .writeStream.outputMode("append")
                .foreachBatch(save)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        return query

    query = drain()
    if final:
        marker.write.mode("append").parquet(ends)
        query = drain()
    return query


def accounted(spark: SparkSession, out: str, lateness: str = LATENESS) -> DataFrame:
    """What became of all rows that ``run_monitor`` has been sent, per day and variant.

    ``rows_sent`` = ``counted`` + ``repeated`` + ``late`` + ``pending`` + ``undated``. Late rows
    came after their day had closed; of a day whose rows all were, nothing is counted.
    Pending rows wait in a day that has not closed, repeats among them.
    """
    keys = ["date", "variant"]
    arrivals = spark.read.parquet(f"{out}/arrivals")
    days = spark.read.parquet(f"{out}/days")
    # The watermark that the last batch left behind: days that end by it have closed.
    reached = F.expr(f"max(newest) - INTERVAL {lateness}")
    watermark = arrivals.agg(F.unix_seconds(reached)).scalar()
    sent = arrivals.groupBy(*keys).agg(F.sum("rows").alias("rows_sent"))
    closed = days.groupBy(*keys).agg(F.sum("counted").alias("counted"), F.sum("repeated").alias("repeated"))
    both = sent.withColumn("_sent", F.lit(True)).join(
        closed,
        (sent["date"] == closed["date"]) & sent["variant"].eqNullSafe(closed["variant"]),
        "left",
    )
    day_end = (F.unix_date(sent["date"]).cast("long") + 1) * DAY_SECONDS
    counted, repeated = (F.coalesce(c, F.lit(0).cast("long")) for c in ("counted", "repeated"))
    is_closed = day_end <= watermark
    rest = F.col("rows_sent") - counted - repeated
    none = F.lit(0).cast("long")
    return both.where(sent["date"].isNull() | (F.unix_date(sent["date"]) * F.lit(DAY_SECONDS).cast("long") < END_OF_INPUT)).select(
        sent["date"],
        sent["variant"],
        "rows_sent",
        counted.alias("counted"),
        repeated.alias("repeated"),
        F.when(is_closed, rest).otherwise(none).alias("late"),
        F.when(~is_closed, rest).otherwise(none).alias("pending"),
        F.when(sent["date"].isNull(), F.col("rows_sent")).otherwise(none).alias("undated"),
    )


def monitored_activity_log(spark: SparkSession, folder: str, pattern: str) -> str:
    """Run the monitor over all log files of a folder; where its results are."""
    log = (
        spark.readStream.schema(
            "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
            " value double, props string"
        )
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )
    out = shared_folder(spark, "monitor")
    run_monitor(outcome_stream(events_from_activity_log(log)), out, f"{out}/checkpoint", final=True)
    return out


def monitor_activity_log(spark: SparkSession, folder: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Every day of the log files of a folder, and its verdicts."""
    out = monitored_activity_log(spark, folder, pattern)
    return (
        spark.read.parquet(f"{out}/days").drop("batch", "counted", "repeated"),
        spark.read.parquet(f"{out}/verdicts").drop("batch"),
    )
