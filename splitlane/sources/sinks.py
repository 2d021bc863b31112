"""Event, mart and result sinks, and readers for the result files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.sources.contract import EventTables

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder the session names in ``spark.checkpoint.dir``.

    What is written there is removed when the driver ends. Only a local session may go without one; it then gets a temporary folder.
    """
    context = spark.sparkContext
    base = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor sees")
        base = tempfile.mkdtemp(prefix="splitlane-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/splitlane/{purpose}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)  # only what exists can be marked for removal
    files.deleteOnExit(hadoop)
    return path


def write_event(df: DataFrame, path: str) -> None:
    """One event table as snappy Parquet by ``date``; only days present are replaced.

    Timestamps are written as ISO-8601 text of fixed width, so text order is time
    order. The rebalance hint lets Spark split a heavy day over several files and
    pack light days together.
    """
    text = F.concat(F.date_format("timestamp", ISO_PATTERN), F.lit("Z"))
    (
        df.withColumn("timestamp", text)
        .hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("date")
        .parquet(path)
    )


def write_events(events: EventTables, base: str) -> None:
    for name, df in events.items():
        write_event(df, f"{base.rstrip('/')}/{name}")


def save_mart(
    df: DataFrame, table: str, bucket_by: str | None = None, buckets: int = 1024
) -> None:
    """Replace a mart table; bucketing lets later joins on the key skip their shuffle.

    Rows are dealt by the bucket key first, so every bucket is one file.
    """
    if bucket_by:
        df = df.repartition(buckets, bucket_by)
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(table)


def write_json(df: DataFrame, path: str) -> None:
    """Result records as JSON lines, keeping NULL fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(
    spark: SparkSession, path: str, schema: str, multi_line: bool = False
) -> DataFrame:
    """JSON lines, or with ``multi_line`` one pretty-printed document per file."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Result table as CSV with a header in every part."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "false")
        .csv(path)
    )
