"""Suffix arrays over word numbers, built in numpy by doubling the sorted length."""

from __future__ import annotations

import numpy as np


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes sorted by their first ``depth`` tokens (at least), and the ranks by round.

    ``tokens`` are numbers from 0. Round k's ranks name the first ``2**k`` tokens of every
    suffix: equal ranks mean equal tokens. Suffixes still tied at the end are equal over
    that length. Only tied suffixes are sorted again, so long texts without repeats need
    two or three cheap rounds.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    sorted_tokens = tokens[order]
    lead = np.flatnonzero(np.r_[True, sorted_tokens[1:] != sorted_tokens[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[lead, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(lead, sizes)
    tied = np.repeat(sizes > 1, sizes)
    ranks, length = [rank], 1
    while length < depth and tied.any():
        slots = np.flatnonzero(tied)
        members = order[slots]
        after = members + length
        second = np.zeros(len(members), np.int64)
        there = after < n
        second[there] = rank[after[there]] + 1
        key = rank[members] * (n + 1) + second
        by_key = np.argsort(key, kind="stable")
        members, key = members[by_key], key[by_key]
        order[slots] = members
        new = np.r_[True, key[1:] != key[:-1]]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(key)])
        rank = rank.copy()
        rank[members] = np.repeat(slots[new], sizes)
        ranks.append(rank)
        tied[slots] = np.repeat(sizes > 1, sizes)
        length *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length in tokens that each sorted suffix shares with the one before it (0 first).

    Exact where the last round left no ties; else at least that round's length.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        live = np.flatnonzero((left < n) & (right < n))
        same = live[ranks[k][left[live]] == ranks[k][right[live]]]
        for side in (left, right, shared):
            side[same] += 1 << k
    out[1:] = shared
    return out


def narrow(
    tokens: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, at: int, value: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the intervals ``low:high`` whose suffixes have ``value`` as token ``at``."""
    n = len(tokens)

    def bound(right: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                return a
            middle = (a[live] + b[live]) >> 1
            place = order[middle] + at
            found = np.where(place < n, tokens[np.minimum(place, n - 1)], -1)
            before = found <= value[live] if right else found < value[live]
            a[live[before]] = middle[before] + 1
            b[live[~before]] = middle[~before]

    return bound(False), bound(True)
