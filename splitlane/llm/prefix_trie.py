"""Prefix trie of conversations: sorted shards, and a skeleton over their borders.

A turn is named by 16 bytes of the SHA-256 of its role and text, a conversation by the row of
these names, its path. Equal paths are one row first, so a group of copies is no hot spot.
Paths are sorted and cut into shards at splitters, which are themselves beginnings of paths.
All members of a node lie side by side, so a node that no splitter begins with has its whole
subtree in one shard, which finishes it while it streams through its sorted paths. The nodes
on splitter paths are the skeleton, a small trie that every task gets: each shard gives partial
aggregates of them, which are reduced by node and then summed along the skeleton.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.llm.common import stored

#: Bytes that name a turn.
NAME = 16
#: Turns of distinct paths that a shard has, about.
SHARD_TURNS = 10_000
#: Shards at most, sampled paths per shard, and turns of a splitter at most. They bound what
#: goes through the driver (80,000 beginnings of paths, 64 * 16 bytes each at most) and what
#: every task gets (4,000 * 64 skeleton nodes at most).
MOST_SHARDS = 4_000
SAMPLED = 20
SPLITTER_TURNS = 64
#: Bytes of joined ids that one row carries between the two steps of a digest.
PIECE_BYTES = 4096

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends_sha256 string, skeleton int, parent_skeleton int"
)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_name(role: Column, text: Column) -> Column:
    """16 bytes that name a turn; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    spelled = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(spelled, 256)), 1, NAME)


def paths(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, turns``: every conversation's turns in order, as names and code points.

    Turns are ordered by number, null first, equal numbers by the turn's name. Texts become
    20 bytes before any shuffle. Rows without a conversation id belong to none.
    """
    role, text = F.col(f"`{role_col}`"), F.col(f"`{text_col}`")
    narrow = turns.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            turn_name(role, text).alias("name"),
            F.char_length(F.coalesce(text, F.lit(""))).alias("chars"),
        ).alias("one"),
    )
    listed = F.transform(F.sort_array(F.collect_list("one")), lambda t: F.struct(t["name"], t["chars"]))
    return narrow.groupBy("conv_id").agg(listed.alias("turns"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """``path, chars, n, conv_id, ends``: each distinct path, its code points per turn (hex, 8
    digits each), its conversations, the smallest of them, and the digest of their ids."""
    flat = convs.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), "")).alias("path"),
        F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(t["chars"].cast("long")), 8, "0")), "").alias("chars"),
    )
    flat = stored(flat.withColumn("pid", F.unhex(F.sha2("path", 256))), "paths")
    one = flat.groupBy("pid").agg(
        F.first("path").alias("path"),
        F.first("chars").alias("chars"),
        F.count("*").alias("n"),
        F.min("conv_id").alias("conv_id"),
    )
    return one.join(end_digests(flat.select("pid", "conv_id")), "pid").drop("pid")


def end_digests(members: DataFrame) -> DataFrame:
    """``pid, ends``: SHA-256 of each pid's ids, ascending, comma-joined.

    Ids are sorted and joined to pieces in all tasks; only the pieces of one pid, about a
    thousandth of its rows, come together, and are hashed as a stream.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, ids, size = None, 0, [], 0
        out: list[tuple] = []

        def close() -> None:
            if ids:
                out.append((pid, first, ",".join(ids)))

        def batch_of() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())],
                ["pid", "first", "piece"],
            )

        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != pid or size > PIECE_BYTES:
                    close()
                    pid, first, ids, size = p, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(out) > 1000:
                yield batch_of()
        close()
        if out:
            yield batch_of()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for p, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != pid:
                    if sha is not None:
                        done.append((pid, sha.hexdigest()))
                    pid, sha = p, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            if done:
                rows = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1])], ["pid", "ends"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.binary()), pa.array([sha.hexdigest()])], ["pid", "ends"])

    sorted_ids = members.select("pid", "conv_id").orderBy("pid", "conv_id")
    rows = sorted_ids.mapInArrow(pieces, "pid binary, first long, piece string")
    return (
        rows.repartition("pid")
        .sortWithinPartitions("pid", "first")
        .select("pid", "piece")
        .mapInArrow(hashed, "pid binary, ends string")
    )


def splitters(distinct: DataFrame, shard_turns: int = SHARD_TURNS) -> list[bytes]:
    """Sorted beginnings of paths that cut all paths into about equal shards.

    At most ``MOST_SHARDS - 1`` of them, from at most about ``SAMPLED`` paths a shard that are
    picked by hash; shards are about equal in turns.
    """
    turns = F.octet_length("path") / NAME
    total = distinct.agg(F.sum(turns + 1)).head()[0] or 0
    shards = int(min(MOST_SHARDS, -(-total // shard_turns)))
    if shards < 2:
        return []
    rows = distinct.count()
    share = min(1.0, SAMPLED * shards / rows)
    spot = F.pmod(F.xxhash64("path"), F.lit(1 << 30))
    picked = distinct.where(spot < int(share * (1 << 30))).select(
        F.substring("path", 1, SPLITTER_TURNS * NAME).alias("path"), (turns + 1).alias("weight")
    )
    sample = sorted((bytes(r["path"]), r["weight"]) for r in picked.collect())
    whole, seen, out = sum(w for _, w in sample), 0.0, []
    for path, weight in sample:
        if seen >= whole * (len(out) + 1) / shards and path and path not in out[-1:]:
            out.append(path)
        seen += weight
    return out[: MOST_SHARDS - 1]


def skeleton_of(cuts: list[bytes]) -> dict[bytes, int]:
    """A number for every beginning of a splitter; the root is always 0."""
    out = {b"": 0}
    for cut in cuts:
        for end in range(NAME, len(cut) + 1, NAME):
            out.setdefault(cut[:end], len(out))
    return out


class Open:
    """A node whose members are still streaming by."""

    __slots__ = ("conv", "depth", "n", "children", "leaves", "saved", "ends", "chars", "skeleton", "rows")

    def __init__(self, depth: int, chars: int, skeleton: int | None):
        self.conv, self.depth, self.n, self.chars, self.skeleton = None, depth, 0, chars, skeleton
        self.children = self.leaves = self.saved = 0
        self.ends, self.rows = EMPTY_SHA, []


class Shard:
    """Builds the nodes of one shard from its sorted paths; ``out`` collects finished rows.

    A finished node waits in its parent for the parent's smallest conversation, so what is
    held are the children of the nodes on one path. Children of skeleton nodes, whose
    smallest conversation no shard knows, go at once and name the skeleton node instead.
    """

    def __init__(self, skeleton: dict[bytes, int]):
        self.skeleton, self.path, self.out = skeleton, b"", []
        self.stack = [Open(0, 0, 0)]

    def close(self) -> None:
        node = self.stack.pop()
        if node.skeleton is not None:
            self.out.append(
                (node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends, node.skeleton, None)
            )
            return
        node.leaves += node.children == 0
        node.saved += (node.n - 1) * node.chars
        self.out.extend((*row[:2], node.conv, *row[3:]) for row in node.rows)
        up = self.stack[-1]
        up.children += 1
        up.leaves += node.leaves
        up.saved += node.saved
        row = (node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends, None, up.skeleton)
        (self.out if up.skeleton is not None else up.rows).append(row)

    def add(self, path: bytes, chars: str, n: int, conv: int, ends: str) -> None:
        shared, most = 0, min(len(path), len(self.path))
        while shared < most and path[shared : shared + NAME] == self.path[shared : shared + NAME]:
            shared += NAME
        while len(self.stack) - 1 > shared // NAME:
            self.close()
        known = self.stack[-1].skeleton is not None
        for depth in range(shared // NAME + 1, len(path) // NAME + 1):
            number = self.skeleton.get(path[: depth * NAME]) if known else None
            known = number is not None
            self.stack.append(Open(depth, int(chars[8 * depth - 8 : 8 * depth], 16), number))
        for node in self.stack:
            node.n += n
            node.conv = conv if node.conv is None else min(conv, node.conv)
        self.stack[-1].ends = ends
        self.path = path

    def end(self) -> None:
        while self.stack:
            self.close()


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.int32()]
    names = [field.split()[0] for field in NODE.split(",")]
    for k in range(0, len(rows), 10_000):
        columns = zip(*rows[k : k + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def shard_nodes(distinct: DataFrame, cuts: list[bytes], skeleton: dict[bytes, int]) -> DataFrame:
    """Finished nodes of every shard, and partial aggregates of skeleton nodes."""
    context = distinct.sparkSession.sparkContext
    given = context.broadcast((cuts, skeleton))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = given.value[0]
        for batch in batches:
            shard = [bisect_right(cuts, path) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[-1] != now:
                    if shard is not None:
                        shard.end()
                        yield from _batches(shard.out)
                    now, shard = row[-1], Shard(given.value[1])
                shard.add(*row[:-1])
            if shard is not None and len(shard.out) > 10_000:
                yield from _batches(shard.out)
                shard.out = []
        if shard is not None:
            shard.end()
            yield from _batches(shard.out)

    columns = "path binary, chars string, n long, conv_id long, ends string"
    numbered = distinct.select("path", "chars", "n", "conv_id", "ends").mapInArrow(number, f"{columns}, shard int")
    dealt = numbered.repartition(max(1, len(cuts) + 1), "shard").sortWithinPartitions("shard", "path")
    return dealt.mapInArrow(build, NODE)


def reduced_skeleton(partial: DataFrame, skeleton: dict[bytes, int], chars: dict[bytes, int]) -> DataFrame:
    """The skeleton nodes, finished: partials reduced by node, then summed over descendants.

    ``partial`` has at most one row per shard and node on the shard's two borders.
    """
    spark = partial.sparkSession
    children = dict.fromkeys(skeleton, 0)
    for path in skeleton:
        if path:
            children[path[:-NAME]] += 1
    rows = [
        (
            number,
            len(path) // NAME,
            skeleton[path[:-NAME]] if path else None,
            chars.get(path, 0),
            children[path],
            [skeleton[path[:end]] for end in range(0, len(path) + 1, NAME)],
        )
        for path, number in skeleton.items()
    ]
    known = spark.createDataFrame(rows, "skeleton int, depth long, up int, chars long, inner long, line array<int>")
    summed = partial.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("outer"),
        F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"),
        F.max(F.when(F.col("ends_sha256") != EMPTY_SHA, F.col("ends_sha256"))).alias("ends"),
    )
    own = known.join(summed, "skeleton").withColumn("n_children", F.col("outer") + F.col("inner"))
    own = own.withColumns(
        {
            "leaves": F.col("leaves") + (F.col("n_children") == 0).cast("long"),
            "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"),
        }
    )
    below = own.select(F.explode("line").alias("skeleton"), "leaves", "saved")
    below = below.groupBy("skeleton").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ups = own.select(F.col("skeleton").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return (
        own.drop("leaves", "saved")
        .join(below, "skeleton")
        .join(ups, "up", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
            "skeleton",
        )
    )


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``convs`` (of ``paths``: ``conv_id, turns``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` (ids of the
    members that end there). Conversations without turns are members of the root. No
    conversations give no nodes. Copies of a conversation are members like any other; a
    conversation is one row of 20 bytes a turn.
    """
    distinct = stored(distinct_paths(convs), "distinct-paths")
    cuts = splitters(distinct, shard_turns)
    skeleton = skeleton_of(cuts)
    nodes = stored(shard_nodes(distinct, cuts, skeleton), "trie-nodes")
    chars = {}
    if cuts:
        given = distinct.sparkSession.sparkContext.broadcast(skeleton)

        def last_chars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, int] = {}
            for batch in batches:
                for path, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for depth in range(1, len(path) // NAME + 1):
                        number = given.value.get(path[: depth * NAME])
                        if number is None:
                            break
                        found[number] = int(sizes[8 * depth - 8 : 8 * depth], 16)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["skeleton", "chars"]
                )

        by_number = {n: path for path, n in skeleton.items()}
        rows = distinct.select("path", "chars").mapInArrow(last_chars, "skeleton int, chars long")
        chars = {by_number[r["skeleton"]]: r["chars"] for r in rows.groupBy("skeleton").agg(F.max("chars").alias("chars")).collect()}
    finished = stored(reduced_skeleton(nodes.where("skeleton is not null"), skeleton, chars), "skeleton")
    ups = finished.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("up"))
    inner = nodes.where("skeleton is null").join(F.broadcast(ups), "parent_skeleton", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("up", "parent_conv_id"))
    columns = [field.split()[0] for field in NODE.split(",")][:8]
    return inner.select(columns).unionByName(finished.select(columns))


#: Turns that a conversation may take from the first of its hundred, at most.
HEAD_TURNS = 5


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """Conversations c rebuilt: the first h turns of conversation c - c % 100 (none if absent), then
    c's own after its first h, where h = crc32 of the decimal id % 6. Same columns.

    A head of at most ``HEAD_TURNS`` turns goes to at most a hundred conversations.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")
    kept = stored(convs, "conversations")
    heads = kept.where(F.col("conv_id") % 100 == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD_TURNS).alias("head")
    )
    own = kept.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": h})
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))
