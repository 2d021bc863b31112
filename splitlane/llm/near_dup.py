"""Near-duplicates: an inverted join on MinHash signature coordinates, then exact checks.

* Texts with the same shingle set form one class; only its smallest id, the node, goes on.
* A signature has ``COORDINATES`` minima. A node posts under its coordinate-value pairs.
  Pairs at the similarity bound share a binomial number of them; ``MATCHES`` lies four
  deviations under its mean. Two nodes sharing that many, out of all, share at least
  ``COLLISIONS`` among each one's rarest ``COORDINATES - MATCHES + COLLISIONS`` (prefix
  filter), so common pairs are never posted, and values seen once need no posting either.
* Short posting lists give their pairs, whose collisions are counted and held against
  ``COLLISIONS``. Of a longer list, every member meets the list's smallest node first.
  Members linked to it form one component already, and pairs inside it are skipped; the
  others are compared in tiles with all members that share a long list with that node.
* Every link is decided on the full shingle sets. Classes are the connected components.

Pairs that share fewer than ``MATCHES`` coordinates can be missed: about 3 in 100,000
of those exactly at the bound, fewer above it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm import words as W
from splitlane.llm.common import rows_with, small_side, stored
from splitlane.llm.components import components

COORDINATES = 64
COLLISIONS = 4
#: Posting lists up to this length give all their pairs.
SHORT_LIST = 16
#: Members of a tile when the rest of a long list is compared.
TILE = 512

_random = np.random.Generator(np.random.PCG64(77))
_FACTOR = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches_needed(percent: int) -> int:
    """Coordinates that a pair at the bound shares with all but negligible odds."""
    p = percent / 100
    return max(1, int(COORDINATES * p - 4.1 * (COORDINATES * p * (1 - p)) ** 0.5))


def _set_digest(shingles: np.ndarray) -> tuple[int, int]:
    a = np.bitwise_xor.reduce(W.mix(shingles + np.uint64(1)))
    b = np.add.reduce(W.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def text_sets(texts: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """Shingle sets, block by block."""
    raw, offsets = W.utf8(texts)
    for i, j in W.blocks(offsets):
        low = W.LOWER[raw[offsets[i] : offsets[j]]]
        yield W.shingle_sets(W.split(low, offsets[i : j + 1] - offsets[i], W.NOT_SPACE), width)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima per set that isn't empty."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, COORDINATES), np.int32)
    every = np.concatenate(full)
    starts = np.cumsum([0, *map(len, full[:-1])])
    out = np.empty((len(full), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((every * _FACTOR[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out.view(np.int32)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id``, ``n`` (set size), digest ``d1, d2`` and ``signature``; null if the set is empty."""
    schema = "n long, d1 long, d2 long, signature array<int>"

    def compute() -> Callable[[pa.Array], pa.StructArray]:
        def work(texts: pa.Array) -> pa.StructArray:
            n, d1, d2, signature = [], [], [], []
            for sets in text_sets(texts, width):
                rows = iter(_signatures(sets))
                for s in sets:
                    n.append(len(s))
                    a, b = _set_digest(s) if len(s) else (None, None)
                    d1.append(a)
                    d2.append(b)
                    signature.append(next(rows) if len(s) else None)
            return pa.StructArray.from_arrays(
                [
                    pa.array(n, pa.int64()),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.array(signature, pa.list_(pa.int32())),
                ],
                names=["n", "d1", "d2", "signature"],
            )

        return work

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows_with(narrow, "text", schema, compute).select("row.id", "out.*")


def prefix_postings(nodes: DataFrame, matches: int) -> DataFrame:
    """``pair`` (coordinate and value in one long), ``df`` and ``node`` within the prefixes."""
    posted = nodes.select("node", F.posexplode("signature").alias("place", "value")).select(
        "node",
        F.shiftleft(F.col("place").cast("long"), 32)
        .bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        .alias("pair"),
    )
    shared = posted.groupBy("pair").agg(F.count("*").alias("df")).where("df > 1")
    prefix = COORDINATES - matches + COLLISIONS
    unique = F.lit(COORDINATES) - F.size("entries")  # rarest of all, and without partner
    return (
        posted.join(shared, "pair")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("df", "pair"))).alias("entries"))
        .select("node", F.slice("entries", 1, F.greatest(F.lit(prefix) - unique, F.lit(0))).alias("e"))
        .select("node", F.explode("e").alias("e"))
        .select("e.pair", "e.df", "node")
    )


def short_pairs(postings: DataFrame) -> DataFrame:
    """Pairs ``a < b`` with enough collisions in short lists."""
    lists = (
        postings.where(F.col("df") <= SHORT_LIST)
        .groupBy("pair")
        .agg(F.sort_array(F.collect_list("node")).alias("m"))
        .where(F.size("m") > 1)
    )
    return (
        lists.select("m", F.posexplode("m").alias("i", "b"))
        .select("b", F.explode(F.slice("m", 1, F.col("i"))).alias("a"))
        .where("a < b")
        .groupBy("a", "b")
        .count()
        .where(F.col("count") >= COLLISIONS)
        .select("a", "b", F.lit(False).alias("long"))
    )


def hub_pairs(postings: DataFrame) -> DataFrame:
    """Every member of a longer list with the list's smallest node."""
    listed = postings.where(F.col("df") > SHORT_LIST).select("pair", "node")
    hubs = listed.groupBy("pair").agg(F.min("node").alias("hub"))
    return (
        listed.join(hubs, "pair")
        .where("hub < node")
        .select(F.col("hub").alias("a"), F.col("node").alias("b"), F.lit(True).alias("long"))
        .distinct()
    )


def node_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """``node`` and its ``shingles`` (sorted 64-bit hashes as bytes) for the wanted ids."""
    schema = "shingles binary"

    def compute() -> Callable[[pa.Array], pa.StructArray]:
        def work(texts: pa.Array) -> pa.StructArray:
            out = [s.tobytes() for sets in text_sets(texts, width) for s in sets]
            return pa.StructArray.from_arrays([pa.array(out, pa.binary())], names=["shingles"])

        return work

    n = wanted.count()
    picked = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(
        small_side(wanted, n), "node", "left_semi"
    )
    return rows_with(picked, "text", schema, compute).select("row.node", "out.shingles").where(
        F.length("shingles") > 0
    )


def checker(percent: int):
    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            if 100 * len(p) < percent * len(q):
                out.append(False)
                continue
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            both = int((q[at] == p).sum())
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    return linked


def tile_links(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between the open members and all members of one tile; only merging ones."""

    def links(tile: pd.DataFrame) -> pd.DataFrame:
        members, opened = tile[~tile.asking], tile[tile.asking]
        sets = [np.frombuffer(x, np.uint64) for x in members.shingles]
        if not sets or opened.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
        ids = members.node.to_numpy()
        hub = int(tile.hub.iloc[0])
        parent = {hub: hub}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x in ids[members.direct.to_numpy()].tolist():
            parent[x] = hub
        out = []
        for node, raw in zip(opened.node.tolist(), opened.shingles, strict=True):
            own = np.frombuffer(raw, np.uint64)
            low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            n = high - low
            if not n.any():
                continue
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            for x in ids[100 * both >= percent * (len(own) + sizes - both)].tolist():
                p, q = root(node), root(x)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((min(node, x), max(node, x)))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return links


def rest_links(checked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of long-list members that aren't linked to their list's smallest node."""
    members = checked.where("long").select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("ok").alias("direct"))
    counts = (
        members.groupBy("hub")
        .agg(F.count("*").alias("m"), F.sum((~F.col("direct")).cast("long")).alias("s"))
        .where("s > 0 and m > 1")
        .select("hub", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"), F.ceil(F.col("s") / TILE).cast("int").alias("parts"))
    )
    live = members.join(counts, "hub")
    spot = F.xxhash64("node")
    asked = live.select(
        "hub", "node", "direct", F.lit(False).alias("asking"),
        F.pmod(spot, F.col("tiles")).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    asking = live.where(~F.col("direct")).select(
        "hub", "node", "direct", F.lit(True).alias("asking"),
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
        F.pmod(spot, F.col("parts")).cast("int").alias("part"),
    )
    return (
        asked.unionByName(asking)
        .join(sets, "node")
        .groupBy("hub", "part", "tile")
        .applyInPandas(tile_links(percent), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Linked are documents with 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest id reachable, ``kept`` says whether it is the own one.
    Texts without words (null, empty, white space) have no shingles and no link. A row
    without an id cannot be named: it is left out of linking, has a null ``component_id``
    and is kept. Rows that share an id are one document with the links of all its texts.
    No rows give no rows; other columns are ignored.
    """
    table = stored(sketches(docs, id_col, text_col, width), "sketches")
    named = table.where("id is not null and n > 0")
    nodes = stored(
        named.groupBy("d1", "d2").agg(F.min("id").alias("node"), F.first("signature").alias("signature")),
        "nodes",
    )
    postings = stored(prefix_postings(nodes, matches_needed(percent)), "postings")
    pairs = stored(
        short_pairs(postings).unionByName(hub_pairs(postings)).groupBy("a", "b").agg(F.max("long").alias("long")),
        "pairs",
    )
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = stored(node_sets(docs, id_col, text_col, wanted, width), "sets")
    ok = checker(percent)(F.col("left"), F.col("right"))
    checked = stored(
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "long", ok.alias("ok")),
        "checked",
    )
    links = checked.where("ok").select("a", "b").unionByName(rest_links(checked, sets, percent))
    # an id that stands for several texts ties their classes together
    several = named.select("id", "d1", "d2").distinct().groupBy("id").count().where("count > 1")
    ties = (
        named.join(several.select("id"), "id", "left_semi")
        .join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
        .select(F.col("id").alias("a"), F.col("node").alias("b"))
    )
    links = links.unionByName(ties)
    found = components(links, "a", "b")
    rooted = stored(
        nodes.select("d1", "d2", "node").join(found, "node", "left").select(
            "d1", "d2", F.coalesce("root", "node").alias("component")
        ),
        "classes",
    )
    return table.join(rooted, ["d1", "d2"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; same columns.

    The row with the group's smallest id stays. Of rows that share an id one stays, rows
    without an id all do.
    """
    verdict = near_duplicates(docs, id_col, text_col, width, percent)
    gone = stored(verdict.where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    kept = docs.join(small_side(gone, gone.count()), id_col, "left_anti").select(docs.columns)
    repeated = stored(
        docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "repeated"
    )
    n = repeated.count()
    if not n:
        return kept
    single = kept.join(small_side(repeated, n), id_col, "left_anti").select(docs.columns)
    return single.unionByName(
        kept.join(small_side(repeated, n), id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns)
    )
