"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised at its quantiles into ``2**BITS`` steps; numbers as they are,
strings by the first bytes behind the prefix that all of them share, so order is kept.
A dimension of few values spreads them over all steps, so that each value is a slab of the
cube whatever the other dimensions hold.
Rows are sorted by their place on the curve, which keeps neighbours in every dimension
together, and the order is cut into runs of equal row counts. A shard so spans a narrow
range of each dimension, and a reader with a filter on any of them skips most shards.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlane.llm.common import numbered

BITS = 8
SHARDS = 40
_BYTES = 6


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of integer ``points`` (dimensions by rows) below ``2**bits``."""
    x = points.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and mirrorings of each level
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(hit, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def ordered_number(docs: DataFrame, name: str) -> Column:
    """A double in the order of the column; null stays null."""
    column = F.col(f"`{name}`")
    if not isinstance(docs.schema[name].dataType, T.StringType):
        return column.cast("double")
    low, high = docs.agg(F.min(column), F.max(column)).first()
    shared = len(os.path.commonprefix([low, high]).encode()) if low is not None else 0
    part = F.substring(F.encode(column, "UTF-8"), shared + 1, _BYTES)
    return F.conv(F.rpad(F.hex(part), 2 * _BYTES, "0"), 16, 10).cast("double")


def steps(docs: DataFrame, keys: dict[str, Column], bits: int) -> list[list[float]]:
    """Per dimension the values at which its quantised steps begin."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = docs.agg(*[F.percentile_approx(key, shares, 10_000).alias(f"q{i}") for i, key in enumerate(keys.values())]).first()
    return [sorted(set(found or [])) for found in row]


def spread(step: np.ndarray, last: int, bits: int) -> np.ndarray:
    """Steps 0 to ``last`` over the full range below ``2**bits``, in the same order."""
    return step * ((1 << bits) - 1) // max(last, 1)


def hilbert_shards(
    docs: DataFrame, dimensions: Sequence[str], ties: Sequence[Column], shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """``docs`` with ``curve``, ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0).

    Shard sizes differ by one row at most. Rows of one place on the curve follow ``ties``;
    rows equal in those too are interchangeable. Nulls take the lowest step. Fewer rows
    than shards leave shards empty; no rows give no rows. Repeated rows and null ids are
    placed each for itself. Input columns named like the three added ones are replaced, all
    others stay whatever their names.
    """
    keys = {d: ordered_number(docs, d) for d in dimensions}
    bounds = [np.array(b) for b in steps(docs, keys, bits)]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        points = [
            spread(np.where(c.isna(), 0, np.searchsorted(b, c.fillna(-np.inf).to_numpy(float), "right")), len(b), bits)
            for b, c in zip(bounds, columns, strict=True)
        ]
        return pd.Series(hilbert_index(np.stack(points), bits))

    kept = [c for c in docs.columns if c not in ("curve", "shard", "slot")]
    order = ["curve", *[f"tie{i}" for i in range(len(ties))]]
    placed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        curve(*keys.values()).alias("curve"),
        *[tie.alias(f"tie{i}") for i, tie in enumerate(ties)],
    )
    rows, total = numbered(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "curve"), "rank", "curve-order"
    )
    shard = F.expr(f"int(rank * {shards} div {max(total, 1)})")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    cut = rows.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
    return cut.select(*[F.col("row").getField(c).alias(c) for c in kept], "curve", "shard", "slot")


def shard_ranges(placed: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Rows and the least and largest value of every dimension, by shard: what pruning reads."""
    bounds = [f(F.col(f"`{d}`")).alias(f"{p}_{d}") for d in dimensions for f, p in ((F.min, "min"), (F.max, "max"))]
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), *bounds)


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes the rows of ``hilbert_shards`` in curve order, one folder per shard."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
