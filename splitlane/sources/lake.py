"""Date-partitioned Parquet event tables: scan and named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.sources.contract import EVENT_NAMES, RAW_SCHEMAS, EventTables


WITH_OFFSET = r":\d\d(\.\d+)? ?[+-]\d"


def parse_timestamps(df: DataFrame) -> DataFrame:
    """ISO-8601 text to a UTC wall-clock timestamp; unreadable text becomes NULL.

    Text with an offset is moved to UTC; text without one is in UTC already.
    """
    if dict(df.dtypes)["timestamp"] != "string":
        return df
    text = F.col("timestamp")
    seconds = F.unix_micros(text.try_cast("timestamp")).cast("decimal(20,0)") / F.lit(
        1_000_000
    ).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    moved = epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    plain = text.try_cast("timestamp_ntz")
    return df.withColumn(
        "timestamp", F.when(text.rlike(WITH_OFFSET), moved).otherwise(plain)
    )


def read_event(
    spark: SparkSession, base: str, name: str, keep_extra: bool = False
) -> DataFrame:
    """Scan ``base/name/date=*/``.

    Part files may lack columns or hold them in another order: the declared schema
    resolves columns by name and fills absent ones with NULL, with no footer merge.
    ``keep_extra`` merges the footers to keep columns outside the contract as well,
    such as a segment column.
    """
    path, schema = f"{base.rstrip('/')}/{name}", RAW_SCHEMAS[name]
    if keep_extra:
        found = spark.read.option("mergeSchema", "true").parquet(path).schema
        declared = spark.read.schema(schema).parquet(path).schema
        extra = [f for f in found.fields if f.name not in declared.fieldNames()]
        schema = type(found)([*declared.fields, *extra])
    return parse_timestamps(spark.read.schema(schema).parquet(path))


def read_events(
    spark: SparkSession, base: str, keep_extra: bool = False
) -> EventTables:
    return EventTables(
        **{name: read_event(spark, base, name, keep_extra) for name in EVENT_NAMES}
    )


def register_views(events: EventTables, prefix: str = "") -> None:
    """Expose the tables to ``spark.sql`` under their contract names."""
    for name, df in events.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
