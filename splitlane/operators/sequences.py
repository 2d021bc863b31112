"""Frequent sequences of events within checkouts, by prefix projection.

A pattern is found where its items occur in this order, with anything in between. The
projection of a pattern keeps, for every checkout that has it, where its earliest match
ends; patterns one item longer come from the rows behind that place. Patterns below the
support go at once, because no longer pattern can have more support than its beginning.
Checkouts stay spread over rows: nothing collects one into an array or a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.sources.contract import EventTables
from splitlane.sources.sinks import shared_folder

#: Items of a pattern at most, and the share of all sequences that it must be found in.
LONGEST = 3
MIN_SUPPORT = 0.01


def _stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written and read back: each level is worked out once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frequent_sequences(
    rows: DataFrame,
    sequence: str,
    place: Column,
    item: Column,
    min_support: float | int = MIN_SUPPORT,
    longest: int = LONGEST,
) -> DataFrame:
    """``pattern`` (array of items), ``length``, ``support``, ``control_support``, ``treatment_support``.

    ``place`` orders the rows of a sequence; rows of one place are in the order of their items.
    ``min_support`` is a share of all sequences if below 1, else a number of them; support counts
    each sequence once, ``<variant>_support`` by the variant of the match's last row. Rows without
    sequence, place or item belong to no pattern.
    """
    if longest < 1 or min_support <= 0:
        raise ValueError("patterns need at least one item and some support")
    folder = shared_folder(rows.sparkSession, "sequences")
    narrow = rows.select(
        F.col(sequence).alias("sequence"), F.struct(place.alias("place"), item.alias("item")).alias("at"), "variant"
    ).where(F.col("sequence").isNotNull() & F.col("at.place").isNotNull() & F.col("at.item").isNotNull())
    # Rows equal in all three are repeats of an item at one moment: numbered, so that each counts.
    narrow = _stored(
        narrow.groupBy("sequence", "at")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("variant").alias("variant")),
        f"{folder}/rows",
    )
    total = narrow.agg(F.count_distinct("sequence")).scalar()
    least = F.greatest(F.ceil(F.lit(float(min_support)) * total), F.lit(1)) if min_support < 1 else F.lit(int(min_support))

    def supported(projected: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """The projection cut to frequent patterns, and these with their support."""
        projected = _stored(projected, f"{folder}/level{level}")
        support = projected.groupBy("pattern").agg(
            F.count(F.lit(1)).alias("support"),
            *[F.count_if(F.col("variant") == v).alias(f"{v}_support") for v in ("control", "treatment")],
        )
        frequent = _stored(support.where(F.col("support") >= least), f"{folder}/frequent{level}")
        return projected.join(frequent.select("pattern"), "pattern", "left_semi"), frequent

    # ``used`` copies of the item at ``end`` belong to the match already.
    first = narrow.groupBy("sequence", F.array("at.item").alias("pattern")).agg(
        F.min("at").alias("end"), F.min_by("copies", "at").alias("copies"), F.min_by("variant", "at").alias("variant")
    ).withColumn("used", F.lit(1).cast("bigint"))
    level, found = supported(first, 1)
    for length in range(2, longest + 1):
        behind = level.alias("p").join(
            narrow.alias("r"),
            (F.col("p.sequence") == F.col("r.sequence"))
            & ((F.col("r.at") > F.col("p.end")) | ((F.col("r.at") == F.col("p.end")) & (F.col("p.copies") > F.col("p.used")))),
        )
        grown = behind.select(
            F.col("p.sequence").alias("sequence"),
            F.concat("p.pattern", F.array("r.at.item")).alias("pattern"),
            F.col("r.at").alias("end"),
            F.col("r.copies").alias("copies"),
            F.col("r.variant").alias("variant"),
            F.when(F.col("r.at") == F.col("p.end"), F.col("p.used") + 1).otherwise(F.lit(1)).cast("bigint").alias("used"),
        )
        rest = ("end", "copies", "variant", "used")
        projected = grown.groupBy("sequence", "pattern").agg(F.min(F.struct(*rest)).alias("_m")).select(
            "sequence", "pattern", *[F.col(f"_m.{c}").alias(c) for c in rest]
        )
        level, more = supported(projected, length)
        found = found.unionByName(more)
    return found.select(
        "pattern", F.size("pattern").cast("bigint").alias("length"), "support", "control_support", "treatment_support"
    )


def error_patterns(events: EventTables, min_support: float | int = MIN_SUPPORT, longest: int = LONGEST) -> DataFrame:
    """Sequences of form errors that many checkouts go through, as ``step/code > step/code``.

    ``share`` is that of all checkouts with an error; ``repeats`` says whether an item comes twice.
    """
    item = F.concat_ws("/", "step_name", "error_code")
    found = frequent_sequences(events.form_error, "checkout_id", F.col("timestamp"), item, min_support, longest)
    timed = F.col("timestamp").isNotNull()
    total = events.form_error.where(timed).agg(F.count_distinct("checkout_id")).scalar()
    return found.select(
        F.array_join("pattern", " > ").alias("pattern"),
        "length",
        "support",
        "control_support",
        "treatment_support",
        F.try_divide(F.col("support").cast("double"), total).alias("share"),
        (F.size(F.array_distinct("pattern")) < F.size("pattern")).alias("repeats"),
    )
