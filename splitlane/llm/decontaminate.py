"""Benchmark decontamination with suffix arrays over the training texts.

Training texts are cut into shards, blocks of whole texts that a task sorts in memory.
A shard's suffix array orders all its word suffixes, up to the longest test item: beyond
that no test suffix can tell them apart. Every test suffix is binary-searched in every
shard, one word at a time, which gives the interval of its occurrences for each length.
Occurrences of whole windows mark words; extended to both sides they are the longest
verbatim matches with their locations. Nothing is shuffled.

The test set is the stated query set. It goes to the tasks in blocks of at most
``TEST_BYTES`` of text, one pass over the training texts each; the driver holds one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.llm import words as W
from splitlane.llm.common import numbered, original, rows_with, stored
from splitlane.llm.suffixes import narrow, suffix_array

WINDOW = 10
#: Bytes of test text that a task holds at once (an item longer than that is its own block).
TEST_BYTES = 16 << 20

SPANS = "array<struct<start:long,end:long>>"
RESULT = (
    f"n_words long, spans {SPANS}, items array<string>,"
    " matches array<struct<item:string,item_start:long,doc_start:long,length:long>>"
)


class TestItems:
    """Words of a block of test items, and the windows to look for."""

    __test__ = False

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        raw, offsets = W.utf8(pa.array(texts, pa.string()))
        found = W.split(W.LOWER[raw], offsets, W.ALNUM)
        self.ids = np.array(["" if i is None else i for i in ids], object)
        self.hash = found.hash
        self.item = found.text
        self.first = found.first
        self.left = found.first[1:][self.item] - np.arange(len(self.hash))  # words to the item's end
        count = found.count[self.item]
        inner = np.arange(len(self.hash)) - found.first[:-1][self.item]
        #: window length of the suffixes that start a window, else 0
        self.window = np.where(count >= window, np.where(self.left >= window, window, 0), np.where(inner == 0, count, 0))
        self.depth = int(found.count.max(initial=0))


def shard_matches(raw: np.ndarray, offsets: np.ndarray, test: TestItems) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words and tokens of a shard, ``(text, token, test suffix, window)`` of each occurrence,
    and the shard's number of every test word (-1: not there)."""
    found = W.split(W.LOWER[raw], offsets, W.ALNUM)
    known, code = np.unique(found.hash, return_inverse=True)
    n_texts = len(offsets) - 1
    # a separator of its own ends each text
    tokens = np.empty(len(code) + n_texts, np.int64)
    place = np.arange(len(code)) + found.text
    tokens[place] = code
    tokens[found.first[1:] + np.arange(n_texts)] = len(known) + np.arange(n_texts)
    order, _ = suffix_array(tokens, test.depth)
    want = np.searchsorted(known, test.hash)
    want[want == len(known)] = 0
    want = np.where(known[want] == test.hash, want, -1) if len(known) else np.full(len(test.hash), -1)
    live = np.flatnonzero(want >= 0)
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(tokens))
    rows, depth = [], 0
    while len(live):
        low, high = narrow(tokens, order, low, high, depth, want[live + depth])
        depth += 1
        here = np.flatnonzero((high > low) & (test.window[live] == depth))
        if len(here):
            n = (high - low)[here]
            at = np.repeat(low[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows.append(np.stack([order[at], np.repeat(live[here], n), np.full(len(at), depth)]))
        go = (high > low) & (test.left[live] > depth) & (test.window[live] > depth)
        live, low, high = live[go], low[go], high[go]
        known_next = want[live + depth] >= 0
        live, low, high = live[known_next], low[known_next], high[known_next]
    if not rows:
        return found, tokens, np.zeros((0, 4), np.int64), want
    spot, suffix, length = np.concatenate(rows, axis=1)
    starts = found.first[:-1] + np.arange(n_texts)
    text = np.searchsorted(starts, spot, "right") - 1
    return found, tokens, np.stack([text, spot, suffix, length], axis=1), want


def extend(tokens: np.ndarray, want: np.ndarray, test: TestItems, rows: np.ndarray) -> np.ndarray:
    """Occurrences extended to the right; those that also match one word further left go."""
    spot, suffix, length = rows[:, 1].copy(), rows[:, 2], rows[:, 3].copy()
    same_item = (suffix > 0) & (test.left[suffix - 1] > 1)
    inner = (spot > 0) & same_item & (tokens[spot - 1] == want[suffix - 1])
    rows, spot, suffix, length = rows[~inner], spot[~inner], suffix[~inner], length[~inner]
    live = np.arange(len(rows))
    while len(live):
        live = live[length[live] < test.left[suffix[live]]]
        live = live[tokens[spot[live] + length[live]] == want[suffix[live] + length[live]]]
        length[live] += 1
    out = rows.copy()
    out[:, 3] = length
    return out


def union(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def searcher(test: TestItems) -> Callable[[], Callable[[pa.Array], pa.StructArray]]:
    def compute() -> Callable[[pa.Array], pa.StructArray]:
        def work(texts: pa.Array) -> pa.StructArray:
            n_words, spans, items, matches = [], [], [], []
            raw, offsets = W.utf8(texts)
            for i, j in W.blocks(offsets):
                found, tokens, rows, want = shard_matches(
                    raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], test
                )
                n_words += found.count.tolist()
                base = len(spans)
                for out in (spans, items, matches):
                    out.extend([] for _ in range(j - i))
                if not len(rows):
                    continue
                longest = extend(tokens, want, test, rows)
                begin = found.first[:-1] + np.arange(j - i)  # of each text among the tokens
                for text in np.unique(rows[:, 0]).tolist():
                    own = rows[rows[:, 0] == text]
                    start = own[:, 1] - begin[text]
                    spans[base + text] = [
                        {"start": a, "end": b} for a, b in union(np.stack([start, start + own[:, 3]], axis=1))
                    ]
                    items[base + text] = sorted(set(test.ids[np.unique(test.item[own[:, 2]])]))
                    far = longest[longest[:, 0] == text]
                    matches[base + text] = [
                        {
                            "item": test.ids[test.item[s]],
                            "item_start": int(s - test.first[test.item[s]]),
                            "doc_start": int(p - begin[text]),
                            "length": int(n),
                        }
                        for _, p, s, n in far.tolist()
                    ]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            match = pa.list_(
                pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())])
            )
            return pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(matches, match)],
                names=["n_words", "spans", "items", "matches"],
            )

        return work

    return compute


def test_blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[int, Iterator[TestItems]]:
    """Number of blocks of the test set, each of bounded size, and the blocks. A block is
    fetched when it is asked for; at least one, empty without items, comes."""
    sized = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // TEST_BYTES) + 1
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))

    def fetch() -> Iterator[TestItems]:
        for k in range(n):
            rows = sized.where(part == k).orderBy("id", "text").collect()
            yield TestItems([r.id for r in rows], [r.text for r in rows], window)

    return n, fetch()


def _merge(rows) -> list[dict]:
    pairs = np.array([[r["start"], r["end"]] for r in rows], np.int64).reshape(-1, 2)
    return [{"start": a, "end": b} for a, b in union(pairs)]


def merged(spans: Column) -> Column:
    @F.pandas_udf(SPANS)
    def merge(rows: pd.Series) -> pd.Series:
        return rows.map(_merge)

    return merge(spans)


def _over_blocks(docs: DataFrame, text_col: str, blocks: Iterator[TestItems]) -> DataFrame:
    """``contamination`` with several blocks: the hits of each are a written table before the
    next block is fetched, and meet the documents again by their number."""
    frame = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    frame, _ = numbered(frame, "spot", "contamination-docs")
    hits = n_words = None
    for block in blocks:
        found = rows_with(frame.select("spot", "text"), "text", RESULT, searcher(block)).select("row.spot", "out.*")
        if n_words is None:
            n_words = stored(found, "contamination-first")
            step = n_words.where(F.size("spans") > 0)
            n_words = n_words.select("spot", "n_words")
        else:
            step = stored(found.where(F.size("spans") > 0), "contamination-block")
        step = step.select("spot", "spans", "items", "matches")
        hits = step if hits is None else hits.unionByName(step)
    every = lambda field: F.flatten(F.collect_list(field))
    hits = hits.groupBy("spot").agg(
        every("spans").alias("spans"), every("items").alias("items"), every("matches").alias("matches")
    )
    none = lambda field: F.coalesce(F.col(field), F.array().cast(hits.schema[field].dataType))
    return (
        frame.select("spot", "row")
        .join(n_words, "spot")
        .join(hits, "spot", "left")
        .select(
            "row",
            F.struct(
                "n_words",
                merged(none("spans")).alias("spans"),
                F.sort_array(F.array_distinct(none("items"))).alias("items"),
                F.array_sort(none("matches")).alias("matches"),
            ).alias("out"),
        )
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``row`` (the input columns) and ``out`` for every row of ``docs``.

    ``out``: ``n_words``; ``spans``, the disjoint word ranges covered by occurrences of
    test windows; ``items``, the ids of their items, sorted; ``matches``, the longest
    verbatim matches as item, first word in item and document, and length.
    A window is ``window`` consecutive words of an item, or the whole of a shorter one.
    Null and empty texts have no words and no spans, items without words match nothing,
    an item without id counts under the empty id, items sharing an id count once. Without
    items, or without documents, nothing is hit.
    """
    n, blocks = test_blocks(benchmark, item_id, item_text, window)
    if n == 1:
        return rows_with(docs, text_col, RESULT, searcher(next(blocks)))
    return _over_blocks(docs, text_col, blocks)


def hit_words(out: str = "out") -> Column:
    return F.aggregate(F.col(f"{out}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a test window; same columns."""
    return original(contamination(docs, benchmark, **options).where(F.size("out.spans") == 0), docs.columns)
