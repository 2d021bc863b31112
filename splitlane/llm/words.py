"""Words of many texts at once, in numpy, straight from Arrow's UTF-8 buffers.

A word is named by a 64-bit hash of its bytes. Byte ``b`` at place ``j`` adds
``value[b] * radix**j``; a running sum over the block gives every word's share in one
subtraction, and dividing by ``radix**start`` makes it independent of the place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
_random = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: ``[^\x20\x09-\x0D]``: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(_RADIX), table(pow(_RADIX, -1, 2**64))


@lru_cache(maxsize=1)
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BLOCK_BYTES + 1)


def _sized_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers; only those of a block are kept for the next call."""
    return _block_powers() if n <= BLOCK_BYTES + 1 else _powers(n)


def sizes(texts: pa.Array) -> np.ndarray:
    """Where each text or binary value starts, in bytes (one entry more than values)."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts (one entry more than texts); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of a block of texts: byte bounds, hashes, and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one entry more than texts

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every ``start:end``, the same wherever they stand."""
    n = len(raw)
    power, inverse = _sized_powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def split(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """The maximal runs of bytes in ``member``, within each text."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = member[raw]
    opens = inside[1:] & ~inside[:-1]  # at byte i: a run starts
    closes = ~inside[1:] & inside[:-1]  # at byte i: a run has ended before it
    cut = offsets[1:-1]  # texts lie side by side
    cut = cut[(cut > 0) & (cut < n)]
    both = inside[cut] & inside[cut + 1]
    opens[cut[both]] = True
    closes[cut[both]] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    hashes = hashed(raw, start, end)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


def joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive hashes, none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _PLACE[0]
    for j in range(1, width):
        total += hashes[j : j + n] * _PLACE[j]
    return mix(total + np.uint64(width))


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; with fewer words the whole sequence is one."""
    every = joined(words.hash, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(joined(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
