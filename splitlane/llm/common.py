"""Tables, intermediate results and Arrow plumbing shared by the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlane.llm import words as W

#: Ids that may be broadcast at most; above it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Bytes of texts that a worker handles before their results leave it.
SLICE_BYTES = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only a local session may leave it unset; it then gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)  # only what exists can be marked for removal
    files.deleteOnExit(hadoop)
    return f"{folder}/table"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a written table: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(ids: DataFrame, n: int) -> DataFrame:
    """Marks ``ids`` for broadcast if its counted rows ``n`` stay under the bound."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def release() -> None:
    """Gives memory that this worker has freed back to the system.

    Spark keeps Python workers for later tasks and stages, and freed memory stays with them.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rows_with(
    df: DataFrame,
    text: str,
    result: str,
    compute: Callable[[], Callable[[pa.Array], pa.StructArray]],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``row`` (all columns of ``df`` as a struct) and ``out`` (one struct per text).

    ``result`` is the struct's DDL. ``compute`` builds the function once per task; it gets about
    ``slice_bytes`` of texts at a time (a longer text alone), whose results leave the worker
    before the next slice.
    Keeping the input inside ``row`` means that no column name can clash.
    """
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = T.StructType(
        [T.StructField("row", source.schema["row"].dataType), T.StructField("out", T.StructType.fromDDL(result))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in batches:
            if batch.num_rows:
                row = batch.column(0)
                texts = row.field(text) if row.null_count == 0 else row.flatten()[row.type.get_field_index(text)]
                for i, j in W.blocks(W.sizes(texts), slice_bytes):
                    out = work(texts.slice(i, j - i))
                    yield pa.RecordBatch.from_arrays([row.slice(i, j - i), out], names=["row", "out"])
        del work
        release()

    return source.mapInArrow(run, schema)


def original(df: DataFrame, columns: list[str]) -> DataFrame:
    """Back from ``row`` to the columns that the input had."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def numbered(df: DataFrame, name: str, label: str) -> tuple[DataFrame, int]:
    """``df`` stored, with a gapless ``name`` from 0 in its present order, and its rows.

    Only one count per partition goes through the driver.
    """
    spot = F.monotonically_increasing_id()
    marked = stored(
        df.withColumns({"__part": F.spark_partition_id(), "__spot": spot.bitwiseAND(F.lit((1 << 33) - 1))}),
        label,
    )
    counts = sorted((r["__part"], r["count"]) for r in marked.groupBy("__part").count().collect())
    total, offsets = 0, []
    for part, n in counts:
        offsets.append((part, total))
        total += n
    if not offsets:
        offsets = [(0, 0)]
    places = df.sparkSession.createDataFrame(offsets, "__part int, __before long")
    return (
        marked.join(F.broadcast(places), "__part")
        .withColumn(name, F.col("__before") + F.col("__spot"))
        .drop("__part", "__spot", "__before"),
        total,
    )
