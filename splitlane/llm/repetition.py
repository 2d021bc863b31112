"""Repetition rules from suffix arrays: how much of a text repeats inside itself.

The word suffixes of a block of texts are sorted together; a word is numbered by text and
hash, so no two texts share a token and no prefix crosses a border. A suffix's longest
common prefix with its neighbours is the longest repeated run of words that starts there:
runs of ``MIN_WORDS`` words and more are united to covered words. The intervals of the
common prefixes form a tree; one whose suffixes don't all follow the same word is a maximal
repeat: lengthened on either side, it would lose an occurrence. A text fails when too large a
share of it is covered, or when one repeated run is too long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm import words as W
from splitlane.llm.common import rows_with
from splitlane.llm.suffixes import common_prefixes, suffix_array

#: A repeated run counts from this many words on.
MIN_WORDS = 5
#: Texts with fewer words fail.
FEWEST_WORDS = 10
#: Most per cent of the words that repeated runs may cover.
MOST_COVERED = 20
#: Longest repeated run allowed, in words.
MOST_REPEAT = 100

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False
NOT_CONTINUED = np.array([b & 0xC0 != 0x80 for b in range(256)])

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " longest_repeat long, repeats array<struct<start:long,length:long>>,"
    " maximal array<struct<start:long,length:long,times:long>>"
)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def prefix_array(found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token of every word, the sorted suffixes, and what each shares with the one before."""
    text = found.text.astype(np.uint64)
    _, tokens = np.unique(W.mix(found.hash + text * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
    order, ranks = suffix_array(tokens, int(found.count.max(initial=0)) + 1)
    return tokens, order, common_prefixes(order, ranks)


def longest_runs(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For every word the longest run from there that also starts elsewhere in its text."""
    run = np.zeros(len(order), np.int64)
    run[order] = np.maximum(shared, np.r_[shared[1:], 0]) if len(shared) else shared
    return run


def intervals(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """Rows ``low, high, length, first``: the suffixes ``low`` to ``high`` of the order share
    ``length`` words (``least`` or more), their neighbours fewer; ``first`` is the earliest."""
    out: list[tuple[int, int, int, int]] = []
    growing: list[list[int]] = []  # length, low, first; each inside the one before

    def end(above: int, at: int, earliest: int) -> tuple[int, int]:
        low = at
        while growing and growing[-1][0] > above:
            length, low, first = growing.pop()
            earliest = min(first, earliest)
            out.append((low, at, length, earliest))
        return low, earliest

    spots = np.flatnonzero(shared >= least)
    last = last_suffix = -1
    for k, length, before, here in zip(
        spots.tolist(), shared[spots].tolist(), order[spots - 1].tolist(), order[spots].tolist(), strict=True
    ):
        if k != last + 1:
            end(0, last, last_suffix)
        low, earliest = end(length, k - 1, before)
        if growing and growing[-1][0] == length:
            growing[-1][2] = min(growing[-1][2], earliest)
        else:
            growing.append([length, low, earliest])
        last, last_suffix = k, here
    end(0, last, last_suffix)
    return np.array(out, np.int64).reshape(-1, 4)


def maximal_repeats(found: W.Words, tokens: np.ndarray, order: np.ndarray, shared: np.ndarray) -> pa.ListArray:
    """Every maximal repeat of every text: first word, length, and how often it occurs."""
    low, high, length, first = intervals(order, shared, MIN_WORDS).T
    leads = np.zeros(len(tokens) + 1, bool)
    leads[found.first] = True
    begins, prior = leads[order], tokens[order - 1]
    change = np.zeros(len(order), np.int64)
    change[1:] = begins[1:] | begins[:-1] | (prior[1:] != prior[:-1])
    changes = np.cumsum(change)
    free = changes[high] > changes[low] if len(high) else np.zeros(0, bool)
    low, high, length, first = low[free], high[free], length[free], first[free]
    by_place = np.lexsort((length, first))
    low, high, length, first = low[by_place], high[by_place], length[by_place], first[by_place]
    text = found.text[first]
    offsets = np.searchsorted(text, np.arange(len(found.count) + 1))
    values = [pa.array(v, pa.int64()) for v in (first - found.first[text], length, high - low + 1)]
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, names=["start", "length", "times"])
    )


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list | pa.ListArray]:
    found = W.split(raw, offsets, W.NOT_SPACE)
    n_texts = len(offsets) - 1
    tokens, order, shared = prefix_array(found)
    run = longest_runs(order, shared)
    at = np.arange(len(run))
    counted = run >= MIN_WORDS
    edge = np.zeros(len(run) + 1, np.int64)
    np.add.at(edge, at[counted], 1)
    np.add.at(edge, (at + run)[counted], -1)
    covered = np.cumsum(edge[:-1]) > 0
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, found.text, run)
    before = np.r_[0, run[:-1]] if len(run) else run
    outer = np.flatnonzero(counted & (before <= run))
    text = found.text[outer]
    repeats: list[list[dict]] = [[] for _ in range(n_texts)]
    for t, start, length in zip(
        text.tolist(), (outer - found.first[text]).tolist(), run[outer].tolist(), strict=True
    ):
        repeats[t].append({"start": start, "length": length})
    lines = W.split(raw, offsets, NOT_NEWLINE)
    filled = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(W.NOT_SPACE[raw], out=filled[1:])
    wordy = filled[lines.end] > filled[lines.start]
    keys = np.stack([lines.text[wordy].astype(np.uint64), lines.hash[wordy]], axis=1)
    distinct = np.unique(keys, axis=0)[:, 0].astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    dup = np.bincount(lines.text[wordy], minlength=n_texts) - np.bincount(distinct, minlength=n_texts)
    return {
        "n_words": found.count,
        "word_chars": per_text(W.NOT_SPACE[raw] & NOT_CONTINUED[raw], offsets),
        "n_symbols": per_text(SYMBOL[raw], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": per_text(covered, found.first),
        "longest_repeat": longest,
        "repeats": repeats,
        "maximal": maximal_repeats(found, tokens, order, shared),
    }


def _compute() -> Callable[[pa.Array], pa.StructArray]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    names = [x.strip().split(" ")[0] for x in RESULT.split(" long,")[:6]] + ["repeats"]

    def work(texts: pa.Array) -> pa.StructArray:
        raw, offsets = W.utf8(texts)
        parts: dict[str, list] = {name: [] for name in names}
        maximal = []
        for i, j in W.blocks(offsets):
            found = measure(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            maximal.append(found.pop("maximal"))
            for name, values in found.items():
                parts[name].extend(values)
        arrays = [pa.array(parts[name], kind if name == "repeats" else pa.int64()) for name in names]
        return pa.StructArray.from_arrays([*arrays, pa.concat_arrays(maximal)], names=[*names, "maximal"])

    return work


def repetition(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the input columns) and ``out`` for every row of ``docs``.

    ``out``: ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier one), ``n_repeat_words``
    (words in repeated runs of ``MIN_WORDS`` and more), ``longest_repeat`` (words),
    ``repeats``, the runs that no run starting one word earlier contains, as first word and
    length, and ``maximal``, every maximal repeat of ``MIN_WORDS`` and more with its first place
    and its number of occurrences (which may overlap). Null and empty texts have zeros and no
    repeats; every row stands for itself, so repeated rows get equal results.
    """
    return rows_with(docs, text_col, RESULT, _compute)


def judged(
    measured: DataFrame, most_covered: int = MOST_COVERED, most_repeat: int = MOST_REPEAT
) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to ``row`` and ``out``."""
    out = F.col("out")
    covered = 100 * out["n_repeat_words"]
    failed = (out["n_words"] < FEWEST_WORDS) | (covered > 20 * out["n_words"])
    fine = (covered <= most_covered * out["n_words"]) & (out["longest_repeat"] <= most_repeat)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & fine})
