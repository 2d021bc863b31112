"""Corpus pipeline over ``documents``: quality, near-duplicates, benchmark, privacy, packing.

Every stage works on all that the one before kept. All but the last return the columns of
``documents``; without rows each returns no rows. Nulls, empty texts and repeated rows are
treated as the operators say: texts without words are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitlane.llm.common import original, stored, table
from splitlane.llm.decontaminate import decontaminated
from splitlane.llm.near_dup import deduplicated
from splitlane.llm.packing import packed
from splitlane.llm.pii import labelled_table, redacted, train_from
from splitlane.llm.weak_labels import quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go."""
    return original(quality(docs).where("out.kept"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, 0.8) stays."""
    return deduplicated(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the new text."""
    return redacted(docs, train_from(labelled_table(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed into sequences; one row per piece."""
    return packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact),
    ("packing", pack),
]

#: The classifier and the field are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
