"""Packing token ids into sequences of equal length and balanced attention cost.

A text's ids are cut into full pieces, each a sequence of its own, and a rest. Rests are
dealt out evenly into blocks; a block opens just enough sequences for its tokens. In
descending order each rest goes to the sequence of lowest cost that still has room, where
a piece of n tokens costs ``LINEAR * n + QUADRATIC * n**2``. If none has room for the
whole, the rest is cut to fill the roomiest ones. So a block pads less than one sequence.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm.common import numbered, rows_with, stored

LENGTH = 1024
LINEAR = 1.0
#: Attention over 1,024 tokens costs about as much as the rest of a layer.
QUADRATIC = 1 / 1024
END_OF_TEXT = 0
#: Rests per block: about 10,000 sequences, so at most 0.01 per cent of padding.
BLOCK_RESTS = 20_000

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


class Ids:
    """Ids of texts, equal to those of the tokenizer file ``VOCABULARY``.

    The same vocabulary as byte ranks encodes several times faster. Its split pattern
    needs a look-ahead only where white space is doubled, so other texts take a form
    without it. Texts that spell out a special token go through the file itself.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.file = Tokenizer.from_file(vocabulary)
        self.special = tuple(t.content for t in self.file.get_added_tokens_decoder().values())
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
        make = lambda name, spaces: tiktoken.Encoding(
            name, pat_str=words + spaces, mergeable_ranks=table, special_tokens={}
        )
        self.plain = make("plain", r"\s+")
        self.spaced = make("spaced", r"\s+(?!\S)|\s+")
        self.doubled = re.compile(r"\s\s")

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.file.encode(text, add_special_tokens=False).ids
        return (self.spaced if self.doubled.search(text) else self.plain).encode_ordinary(text)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cutter(vocabulary: str | None, ranks: str | None, length: int):
    def compute() -> Callable[[pa.Array], pa.StructArray]:
        import public_tokenizers

        encode = Ids(vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS))

        def work(texts: pa.Array) -> pa.StructArray:
            n, crcs, rests = [], [], []
            for value in texts:
                ids = np.array(encode(value.as_py() or "") + [END_OF_TEXT], np.uint32)
                full = len(ids) // length
                n.append(len(ids))
                crcs.append([crc(ids[k * length : (k + 1) * length]) for k in range(full)])
                rests.append(ids[full * length :].astype("<u2").tobytes())
            return pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())],
                names=["n", "crcs", "rest"],
            )

        return work

    return compute


class Open:
    """Sequences by remaining room; finds the cheapest one with enough of it."""

    def __init__(self, count: int, length: int):
        self.size = 1 << length.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
        self.best: list[tuple[float, int]] = [(np.inf, -1)] * (2 * self.size)
        self.heaps[length] = [(0.0, k) for k in range(count)]
        self._update(length)

    def _update(self, room: int) -> None:
        i = room + self.size
        self.best[i] = (self.heaps[room][0][0], room) if self.heaps[room] else (np.inf, -1)
        while i > 1:
            i >>= 1
            self.best[i] = min(self.best[2 * i], self.best[2 * i + 1])

    def room(self, least: int) -> int:
        """The room of the cheapest sequence with at least this much, or -1."""
        i, found = least + self.size, (np.inf, -1)
        j = 2 * self.size
        while i < j:
            if i & 1:
                found = min(found, self.best[i])
                i += 1
            if j & 1:
                j -= 1
                found = min(found, self.best[j])
            i >>= 1
            j >>= 1
        return found[1]

    def roomiest(self) -> int:
        return next(r for r in range(len(self.heaps) - 1, 0, -1) if self.heaps[r])

    def take(self, room: int, n: int, cost: float) -> int:
        before, k = heapq.heappop(self.heaps[room])
        heapq.heappush(self.heaps[room - n], (before + cost, k))
        self._update(room)
        self._update(room - n)
        return k


def pack(lengths: np.ndarray, length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """``(rest, first, tokens, sequence, offset)`` of every piece."""
    if not len(lengths):
        return []
    total = int(lengths.sum())
    sequences = Open(-(-total // length), length)
    out = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        first, left = 0, int(lengths[i])
        while left:
            room = sequences.room(left)
            n = left
            if room < 0:
                room = n = sequences.roomiest()
            k = sequences.take(room, n, linear * n + quadratic * n * n)
            out.append((i, first, n, k, length - room))
            first += n
            left -= n
    return out


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are its text's, then id 0; each lies in exactly one piece. A null or
    empty text is the id 0 alone. ``offset`` is the piece's place in its sequence, gapless
    from 0; ``sequence_id`` is unique, with gaps. Repeated rows are packed each for itself,
    a null id stays null. No rows give no pieces; other columns are ignored.
    ``vocabulary`` and ``ranks`` are paths of one byte-level vocabulary of at most 65,536
    ids in both forms (default: the public 50k one).
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = rows_with(narrow, "text", "n long, crcs array<long>, rest binary", cutter(vocabulary, ranks, length))
    cut, n_docs = numbered(cut.select("row.doc_id", "out.*"), "number", "token-ids")
    full = cut.select("doc_id", "n", F.posexplode("crcs").alias("k", "crc"))
    full, n_full = numbered(full, "sequence_id", "full-pieces")
    whole = full.select(
        "doc_id",
        (F.col("k").cast("long") * length).alias("start"),
        F.lit(length).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        F.lit(0).cast("long").alias("offset"),
    )
    n_blocks = -(-n_docs // BLOCK_RESTS) or 1
    rests = cut.where(F.length("rest") > 0).select(
        "doc_id", "n", "rest", (F.col("number") % n_blocks).cast("int").alias("block")
    )

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        ids = [np.frombuffer(x, "<u2") for x in block.rest]
        rows = pack(np.array([len(x) for x in ids]), length, linear, quadratic)
        which = np.array([r[0] for r in rows], np.int64)
        first = np.array([r[1] for r in rows], np.int64)
        n = np.array([r[2] for r in rows], np.int64)
        doc_tokens = block.n.to_numpy()[which]
        rest_start = doc_tokens // length * length
        return pd.DataFrame(
            {
                "doc_id": block.doc_id.iloc[which].to_numpy(),
                "start": rest_start + first,
                "length": n,
                "ids_crc32": [crc(ids[i][a : a + k]) for i, a, k, _, _ in rows],
                "doc_tokens": doc_tokens,
                "sequence_id": n_full + np.array([r[3] for r in rows]) * n_blocks + int(block.block.iloc[0]),
                "offset": np.array([r[4] for r in rows], np.int64),
            }
        )

    # Each block is a task of its own; by hash, one task would get several.
    dealt = rests.repartitionById(n_blocks, F.col("block"))
    return whole.unionByName(dealt.groupBy("block").applyInPandas(fill, whole.schema))
