"""A bounded pick of rows that does not depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def picked_rows(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows by hash of all their columns; all of a smaller table."""
    share = min(1.0, rows / max(1, df.count()))
    spot = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 30))
    return df.where(spot < int(share * (1 << 30)))
