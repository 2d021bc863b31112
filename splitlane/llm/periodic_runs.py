"""Maximal periodic runs of words, by internal pattern matching.

The word suffixes of a block of texts are sorted together; words are numbered by text and
hash, so nothing matches across texts. On every dyadic level each aligned block of m words
asks where it occurs again in the next four windows of m places. Its occurrences are one
interval of the suffix array, and a wavelet matrix over the array gives the first and the
last of them in a window (range successor and predecessor) without listing the interval.
Within one window they form an arithmetic progression; the distances from the block to its
members are the candidate periods. Members that carry on the progression of the block itself
are multiples of its period and give nothing new. A candidate is extended both ways by
comparing ranks of doubled lengths.

No run is missed: a run of length L and period q holds an aligned block of m words, with
2 m - 1 <= L - q < 4 m - 1, that lies at least q words before the run's end. It occurs again q
words later, and q <= L - q < 4 m.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.llm import words as W
from splitlane.llm.byte_pairs import binaries, spread
from splitlane.llm.common import rows_with
from splitlane.llm.suffixes import suffix_array

#: A run has at least so many words, and at least two periods.
MIN_LENGTH = 12
#: Candidates that are extended at once.
AT_ONCE = 1 << 20

RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class WaveletMatrix:
    """Order statistics over any interval of a list of numbers below ``top``."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = list(range(max(1, int(top).bit_length()) - 1, -1, -1))
        self.zeros: list[np.ndarray] = []
        for bit in self.bits:
            one = (values >> bit) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each ``low:high`` are smaller than ``x`` (at most ``top``)."""
        count = np.zeros(len(low), np.int64)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            up = (x >> bit) & 1 == 1
            count += np.where(up, b - a, 0)
            low = np.where(up, zeros[-1] + low - a, a)
            high = np.where(up, zeros[-1] + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of each ``low:high`` that has ``k`` smaller ones."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            value += up.astype(np.int64) << bit
            low = np.where(up, zeros[-1] + low - a, a)
            high = np.where(up, zeros[-1] + high - b, b)
        return value


def shared_after(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens from ``a`` on equal those from ``b`` on (a < b)."""
    n = len(ranks[0])
    a, b, start = a.copy(), b.copy(), a
    for k in range(len(ranks) - 1, -1, -1):
        live = np.flatnonzero(b < n)
        same = live[ranks[k][a[live]] == ranks[k][b[live]]]
        a[same] += 1 << k
        b[same] += 1 << k
    return a - start


def shared_before(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens just before ``a`` equal those just before ``b`` (a < b)."""
    a, b, start = a.copy(), b.copy(), a
    for k in range(len(ranks) - 1, -1, -1):
        live = np.flatnonzero(a >= 1 << k)
        same = live[ranks[k][a[live] - (1 << k)] == ranks[k][b[live] - (1 << k)]]
        a[same] -= 1 << k
        b[same] -= 1 << k
    return start - a


def candidates(
    matrix: WaveletMatrix, low: np.ndarray, high: np.ndarray, block: np.ndarray, m: int, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and candidate periods: distances to later occurrences within ``4 m - 1`` places.

    ``low:high`` is each block's interval of the suffix array.
    """
    seen = matrix.below(low, high, np.minimum(block + 1, n))
    more = np.flatnonzero(seen < high - low)
    low, high, block, seen = low[more], high[more], block[more], seen[more]
    first = matrix.smallest(low, high, seen)
    near = np.flatnonzero(first - block < 4 * m)
    low, high, block, seen, first = low[near], high[near], block[near], seen[near], first[near]
    starts, periods = [], []
    period, last = first - block, first  # of the progression that the block itself is in
    chained = np.ones(len(block), bool)
    for window in range(4):
        edge = block + (window + 1) * m + (window < 3)  # distances up to 4 m - 1
        until = matrix.below(low, high, np.minimum(edge, n))
        some = np.flatnonzero(until > seen)
        chained[until == seen] = False
        if len(some):
            one, two = low[some], high[some]
            head = matrix.smallest(one, two, seen[some])
            tail = matrix.smallest(one, two, until[some] - 1)
            count = until[some] - seen[some]
            gap = (tail - head) // np.maximum(count - 1, 1)
            if window == 0:  # the block and these are one progression: only the first is new
                going = np.ones(len(some), bool)
                starts.append(block[some])
                periods.append(head - block[some])
            else:
                p = period[some]
                going = chained[some] & (head == last[some] + p) & ((count == 1) | (gap == p)) & (p <= m)
                lone = np.flatnonzero(~going)
                times = count[lone]
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                starts.append(np.repeat(block[some][lone], times))
                periods.append(np.repeat(head[lone] - block[some][lone], times) + step * np.repeat(gap[lone], times))
            chained[some] = going
            last[some] = tail
        seen = until
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(tokens: np.ndarray, longest: int, least: int = MIN_LENGTH) -> np.ndarray:
    """Rows ``start, length, period`` of all maximal runs, by start, then period.

    ``tokens`` are numbers from 0; no repeated stretch has more than ``longest`` of them.
    """
    n = len(tokens)
    none = np.zeros((0, 3), np.int64)
    if n < least:
        return none
    order, ranks = suffix_array(tokens, longest + 1)
    ranks = [r.astype(np.int32) for r in ranks]
    if len(ranks) < 2:
        return none
    matrix = WaveletMatrix(order, n)
    found = []
    for k in range(1, len(ranks)):
        m, rank = 1 << k, ranks[k]
        size = np.bincount(rank, minlength=n)  # by first slot of each interval
        block = np.arange(0, n - m + 1, m)
        block = block[size[rank[block]] > 1]
        step = max(1, AT_ONCE // (3 * m))
        for i in range(0, len(block), step):
            part = block[i : i + step]
            low = rank[part].astype(np.int64)
            start, period = candidates(matrix, low, low + size[low], part, m, n)
            back = shared_before(ranks, start, start + period)
            length = back + shared_after(ranks, start, start + period) + period
            fit = length >= np.maximum(least, 2 * period)
            if fit.any():
                found.append(np.stack([start - back, length, period], axis=1)[fit])
    if not found:
        return none
    every = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    every = every[np.r_[True, (every[1:, :2] != every[:-1, :2]).any(axis=1)]]  # the smallest period of each
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def measure(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: words per text, runs (start counted within the text), runs per text,
    the words outside repetitions joined by blanks, and its bytes per text."""
    found = W.split(raw, offsets, W.NOT_SPACE)
    text = found.text
    _, tokens = np.unique(W.mix(found.hash + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
    runs = find_runs(tokens, int(found.count.max(initial=0)))
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    n_texts = len(offsets) - 1
    size = found.end[kept] - found.start[kept] + 1  # with a blank behind
    joined = spread(np.r_[raw, np.uint8(0)], found.start[kept], found.end[kept] + 1)
    ends = np.cumsum(size)
    joined[ends - 1] = 0x20
    last = np.flatnonzero(np.r_[text[kept][1:] != text[kept][:-1], True]) if len(kept) else kept
    joined = np.delete(joined, ends[last] - 1)
    lengths = np.bincount(text[kept], size, n_texts).astype(np.int64)
    lengths -= lengths > 0
    home = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    runs[:, 0] -= found.first[home]
    return found.count, runs, np.bincount(home, minlength=n_texts), joined, lengths


def _compute() -> Callable[[pa.Array], pa.StructArray]:
    def work(texts: pa.Array) -> pa.StructArray:
        raw, offsets = W.utf8(texts)
        count, runs, per_text, joined, lengths = measure(raw, offsets)
        columns = [pa.array(runs[:, c]) for c in range(3)]
        listed = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32)),
            pa.StructArray.from_arrays(columns, names=["start", "length", "period"]),
        )
        clean = binaries(joined, lengths).cast(pa.string())
        return pa.StructArray.from_arrays([pa.array(count.astype(np.int64)), listed, clean], names=["n_words", "runs", "collapsed"])

    return work


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the input columns) and ``out`` for every row of ``docs``.

    ``out``: ``n_words``; ``runs``, every maximal run as first word, words and smallest period, by
    start, then period; ``collapsed``, the words that no run repeats (outside all runs or in a
    run's first period only), joined by one blank. Null, empty and white texts have no words,
    no runs and an empty ``collapsed``; repeated rows get equal results; no rows give none. A
    text is handled whole: a long one takes about 100 bytes a word and level of doubling.
    """
    return rows_with(docs, text_col, RESULT, _compute, W.BLOCK_BYTES)


def with_periods(doc_id: Column, text: Column) -> Column:
    """``text`` whose words from a place on repeat, in a tenth of all documents; see ``op12``.

    Of h = crc32 of the decimal id and g = h / 10: with h % 10 = 0 every word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8). Other texts, and those
    without an id, stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    rebuilt = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & text.isNotNull() & (n > 0), F.array_join(rebuilt, " ")).otherwise(text)
