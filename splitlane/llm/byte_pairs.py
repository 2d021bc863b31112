"""Byte-level BPE of a corpus: all merges replayed over its distinct words.

The corpus is counted into distinct words (matches of the split pattern). Their bytes lie
side by side as linked tokens, and an inverted index holds, for the rank of every pair in
vocabulary, the positions where that pair stands. Ranks are taken in order; a merge looks
only at the positions of its rank and at the two pairs that each merge makes new. Words that
many blocks of the corpus share are replayed once for all of it, in shards, and handed to the
tasks (a bounded table, most frequent words first). A task replays whatever other words its
texts hold in the same way, so no result depends on which words were shared.

Ids follow the rank file as tiktoken reads it: a word that is in the vocabulary is one id, a
pair may merge if its joined bytes are in the vocabulary, lowest rank first, leftmost first.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm import words as W
from splitlane.llm.common import rows_with, stored

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words that the shared lexicon holds at most, and the bytes that each may have: at most
#: 500,000 * (8 + 4 * 32) bytes = 68 MB, whatever the corpus.
LEXICON_WORDS = 500_000
LEXICON_WORD_BYTES = 32
#: Words that a task keeps beside the lexicon before it forgets them.
KNOWN_WORDS = 100_000
#: Positions of one rank from which on they are merged at once.
AT_ONCE = 128
#: Bytes of text in which words are counted together.
COUNT_BYTES = 1 << 24
#: Code points after which a long text is cut, at the next place no word can cross.
CHUNK = 1 << 19
_CUT = regex.compile(r"(?<=\S)\s")


class Vocabulary:
    """A rank file: bytes to id, id to bytes, and the id that two ids merge to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ids = table
        self.of_byte = np.array([table[bytes([b])] for b in range(256)], np.int64)
        self.width = max(table.values()) + 1

    @cached_property
    def pairs(self) -> dict[int, int]:
        """``left * width + right`` to the id that both together are."""
        out, get = {}, self.ids.get
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                left = get(token[:cut])
                if left is not None:
                    right = get(token[cut:])
                    if right is not None:
                        out[left * self.width + right] = i
        return out

    @cached_property
    def _sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        order = np.argsort(keys)
        return keys[order], np.fromiter(self.pairs.values(), np.int64, len(keys))[order]

    def merged(self, keys: np.ndarray) -> np.ndarray:
        """``pairs`` of many keys, -1 where two ids do not merge."""
        known, values = self._sorted_pairs
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], -1)

    @cached_property
    def byte_pairs(self) -> np.ndarray:
        """The id of every two bytes, or -1."""
        left, right = np.divmod(np.arange(256 * 256), 256)
        return self.merged(self.of_byte[left] * self.width + self.of_byte[right])

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes side by side by id, and where each starts; ids left out are empty."""
        size = np.zeros(self.width + 1, np.int64)
        tokens = sorted((i, token) for token, i in self.ids.items())
        size[[i + 1 for i, _ in tokens]] = [len(token) for _, token in tokens]
        return np.frombuffer(b"".join(token for _, token in tokens), np.uint8), np.cumsum(size)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        raw, starts = self.spelled
        if len(ids) and (ids.max() >= self.width or (np.diff(starts)[ids] == 0).any()):
            raise ValueError("an id is not in the vocabulary")
        return spread(raw, starts[ids], starts[ids + 1])


def spread(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The values of all ``first:end`` in a row."""
    size = end - first
    before = np.cumsum(size) - size
    return values[np.repeat(first - before, size) + np.arange(size.sum())]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Replay:
    """Words' tokens as linked positions, and the positions of every pair by the rank it merges to.

    ``rank[p]`` is what the pair that starts at ``p`` merges to, or -1. Arrays and their numpy
    views share memory: a rank with few positions is replayed one by one, a rank with many at once.
    """

    def __init__(self, words: list[bytes], vocab: Vocabulary):
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.vocab, self.ends, n = vocab, np.cumsum(size), len(raw)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[self.ends[size > 0] - 1] = -1
        before[(self.ends - size)[size > 0]] = -1
        rank = np.full(n, -1, np.int64)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = vocab.byte_pairs[raw[inner].astype(np.int64) * 256 + raw[inner + 1]]
        self.plain = [array("q", x.tobytes()) for x in (vocab.of_byte[raw], after, before, rank)]
        self.views = [np.frombuffer(x, np.int64) if n else np.zeros(0, np.int64) for x in self.plain]
        self.few: dict[int, list[int]] = {}
        self.many: dict[int, list[np.ndarray]] = {}
        self.queue: list[int] = []
        spots = np.flatnonzero(rank >= 0)
        self.post(rank[spots], spots)

    def post(self, ranks: np.ndarray, spots: np.ndarray) -> None:
        """Adds positions to the index under their ranks."""
        order = np.argsort(ranks, kind="stable")
        ranks, spots = ranks[order], spots[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts, ends = np.r_[0, cuts][: len(ranks)], np.r_[cuts, len(ranks)]
        few, many, queue = self.few, self.many, self.queue
        for r, a, b in zip(ranks[firsts].tolist(), firsts.tolist(), ends.tolist(), strict=False):
            if r not in few and r not in many:
                heapq.heappush(queue, r)
            if b - a < AT_ONCE:
                few.setdefault(r, []).extend(spots[a:b].tolist())
            else:
                many.setdefault(r, []).append(spots[a:b])

    def run(self) -> None:
        while self.queue:
            now = heapq.heappop(self.queue)
            here = self.few.pop(now, [])
            arrays = self.many.pop(now, None)
            if arrays or len(here) >= AT_ONCE:
                spots = np.sort(np.concatenate([*(arrays or []), np.array(here, np.int64)]))
                if self.at_once(now, spots):
                    continue
                here = spots.tolist()
            else:
                here.sort()
            self.one_by_one(now, here)

    def at_once(self, now: int, spots: np.ndarray) -> bool:
        """All merges of one rank, unless one opens a lower rank, which would have to go before
        the next of them in the same word."""
        token, after, before, rank = self.views
        width, merged = self.vocab.width, self.vocab.merged
        spots = spots[rank[spots] == now]
        if not len(spots):
            return True
        spots = spots[np.r_[True, spots[1:] != spots[:-1]]]
        joint = np.r_[False, after[spots[:-1]] == spots[1:]]  # shares a token with the one before
        if joint.any():  # leftmost first: every other one of a row
            place = np.arange(len(spots))
            since = place - np.maximum.accumulate(np.where(joint, 0, place))
            spots = spots[since % 2 == 0]
        right = after[spots]
        beyond, left = after[right], before[spots]
        there, lead = beyond >= 0, left >= 0
        lower = merged(np.array([now * width + now]))
        soon = merged(np.concatenate([now * width + token[beyond[there]], token[left[lead]] * width + now]))
        if ((soon >= 0) & (soon < now)).any() or 0 <= lower[0] < now:
            return False
        token[spots], token[right] = now, -1
        rank[spots], rank[right] = -1, -1
        after[spots] = beyond
        before[beyond[there]] = spots[there]
        left = before[spots]
        touched = np.unique(np.concatenate([spots[there], left[left >= 0]]))
        new = merged(token[touched] * width + token[after[touched]])
        rank[touched] = new
        self.post(new[new >= 0], touched[new >= 0])
        return True

    def one_by_one(self, now: int, here: list[int]) -> None:
        token, after, before, rank = self.plain
        few, many, queue, width, get = self.few, self.many, self.queue, self.vocab.width, self.vocab.pairs.get
        for place, at in enumerate(here):
            if rank[at] != now:
                continue  # a merge beside it has changed this pair
            right = after[at]
            token[at], token[right], rank[right] = now, -1, -1
            beyond = after[at] = after[right]
            new, lower = -1, False
            if beyond >= 0:
                before[beyond] = at
                new = get(now * width + token[beyond], -1)
                if new >= 0:
                    if new in few:
                        few[new].append(at)
                    else:
                        few[new] = [at]
                        if new not in many:
                            heapq.heappush(queue, new)
                    lower = new < now
            rank[at] = new
            left = before[at]
            if left >= 0:
                new = rank[left] = get(token[left] * width + now, -1)
                if new >= 0:
                    if new in few:
                        few[new].append(left)
                    else:
                        few[new] = [left]
                        if new not in many:
                            heapq.heappush(queue, new)
                    lower = lower or new < now
            if lower and place + 1 < len(here):  # lower ranks go first, then the rest of this one
                if now not in few and now not in many:
                    heapq.heappush(queue, now)
                few.setdefault(now, []).extend(here[place + 1 :])
                return

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's end."""
        token = self.views[0]
        alive = token >= 0
        counts = np.zeros(len(token) + 1, np.int64)
        np.cumsum(alive, out=counts[1:])
        return token[alive].astype("<u4"), counts[self.ends]


def replay(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of every word, as little-endian unsigned 32-bit integers, by one replay of all merges."""
    work = Replay(words, vocab)
    work.run()
    flat, ends = work.ids()
    data, cuts, whole = flat.tobytes(), (4 * np.r_[0, ends]).tolist(), vocab.ids.get
    return [
        data[a:b] if b - a <= 4 or (one := whole(word)) is None else one.to_bytes(4, "little")
        for word, a, b in zip(words, cuts[:-1], cuts[1:], strict=True)
    ]


LETTER, NUMBER, SPACE, OTHER, DOUBTFUL = range(5)
#: Code points from here on are always doubtful; a table of classes holds those before.
CLASSED = 0x20000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point below ``CLASSED``, and doubtful for all others.

    Doubtful: unassigned in the Unicode of Python's own tables, so that engines may differ.
    """
    out = np.full(CLASSED + 1, OTHER, np.uint8)
    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "-" for c in range(CLASSED))
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for match in regex.finditer(name, points):
            out[match.start() : match.end()] = kind
    unassigned = np.array([unicodedata.category(c) == "Cn" for c in points])
    out[:-1][unassigned] = DOUBTFUL
    out[-1] = DOUBTFUL
    return out


class Splitter:
    """Where the matches of the public split pattern start, for many texts at once.

    In words: a run of letters, of numbers or of other signs, with one blank (U+0020) before it
    if there is one; white space up to its last character, which the next run may take; and the
    contractions 's 't 're 've 'm 'll 'd wherever an apostrophe begins a match. Texts with
    characters whose class is doubtful go through the library's own engine.
    """

    def __init__(self, pattern: str):
        from tokenizers import Regex, pre_tokenizers

        self.exact = pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str

    def starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One flag per code point; ``offsets`` are where texts start (one more than texts)."""
        n = len(points)
        if not n:
            return np.zeros(0, bool)
        kind = classes()[np.minimum(points, CLASSED)]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        first[n] = True
        blank = points == 0x20
        space = kind == SPACE
        out = first[:-1].copy()
        changes = kind[1:] != kind[:-1]
        taken = blank[:-1] & ~space[1:]  # a run that starts with the blank before it
        out[1:] |= changes & ~taken
        out[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]  # the last white space before a run
        mark = np.flatnonzero(points == 0x27)
        if len(mark):
            alone = first[mark] | ((kind[mark - 1] != OTHER) & ~blank[mark - 1])
            self._contractions(points, first, mark[alone], out)
        doubtful = np.flatnonzero(kind == DOUBTFUL)
        for t in np.unique(np.searchsorted(offsets, doubtful, "right") - 1).tolist():
            a, b = int(offsets[t]), int(offsets[t + 1])
            out[a:b] = False
            text = points[a:b].astype("<u4").tobytes().decode("utf-32-le")
            out[[a + place for _, (place, _) in self.exact(text)]] = True
        return out

    @staticmethod
    def _contractions(points: np.ndarray, first: np.ndarray, mark: np.ndarray, out: np.ndarray) -> None:
        n = len(points)
        padded = np.r_[points, 0, 0]
        edge = np.r_[first, True, True]
        one, two = padded[mark + 1], padded[mark + 2]
        there, both = ~edge[mark + 1], ~edge[mark + 1] & ~edge[mark + 2]
        short = there & np.isin(one, [ord(c) for c in "stmd"])
        long = both & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for found, size in ((short, 2), (long, 3)):
            at = mark[found]
            out[at] = True
            out[at + 1] = False
            if size == 3:
                out[at + 2] = False
            after = at + size
            out[after[after < n]] = True


def points_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, where the texts start in them, and every code point's first byte."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    return points, np.searchsorted(lead, offsets), lead


def split_words(raw: np.ndarray, offsets: np.ndarray, splitter: Splitter) -> W.Words:
    """Byte bounds and hashes of all words of a block of texts."""
    points, at, lead = points_of(raw, offsets)
    start = lead[splitter.starts(points, at)]
    end = np.r_[start[1:], len(raw)] if len(start) else start
    return W.Words(start, end, W.hashed(raw, start, end), np.searchsorted(start, offsets))


def chunks(text: str) -> Iterator[str]:
    """Parts of a long text. No word runs from a visible character on into white space."""
    at = 0
    while len(text) - at > CHUNK:
        cut = _CUT.search(text, at + CHUNK)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of blocks of texts, a long text in chunks; null is empty."""
    raw, offsets = W.utf8(texts)
    for i, j in W.blocks(offsets, W.BLOCK_BYTES):
        if offsets[j] - offsets[i] <= W.BLOCK_BYTES:
            yield raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        else:
            for chunk in chunks(texts[i].as_py()):
                data = np.frombuffer(chunk.encode(), np.uint8)
                yield data, np.array([0, len(data)])


def distinct_words(raw: np.ndarray, found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts, and byte bounds of one occurrence, of the distinct words of a block."""
    hashes, first, n = np.unique(found.hash, return_index=True, return_counts=True)
    return hashes, n, found.start[first], found.end[first]


def word_counts(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """``word, n, blocks``: the corpus's distinct words, how often they occur, and in how many
    blocks of about ``COUNT_BYTES``. Counted in the tasks before the shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        hashes, counts, words, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.binary()), 0

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([words[k : k + 20_000], pa.array(counts[k : k + 20_000])], ["word", "n"])

        for batch in batches:
            for raw, offsets in parts(batch.column(0)):
                new, n, start, end = distinct_words(raw, split_words(raw, offsets, split))
                spelled = pa.Array.from_buffers(
                    pa.binary(),
                    len(new),
                    [None, pa.py_buffer(np.r_[0, np.cumsum(end - start)].astype(np.int32)), pa.py_buffer(spread(raw, start, end))],
                )
                every = np.concatenate([hashes, new])
                hashes, first, which = np.unique(every, return_index=True, return_inverse=True)
                counts = np.bincount(which, np.concatenate([counts, n]), len(hashes)).astype(np.int64)
                words = pa.concat_arrays([words, spelled]).take(pa.array(first))
                seen += len(raw)
                if seen > COUNT_BYTES:
                    yield from out()
                    hashes, counts, words, seen = hashes[:0], counts[:0], words[:0], 0
        yield from out()

    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))


def shared_words(counts: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words that several blocks hold, at most ``most`` and none very long.

    Whole steps of frequency are taken, so ties need no order and no task sees all words.
    """
    fit = counts.where((F.col("blocks") > 1) & (F.octet_length("word") <= LEXICON_WORD_BYTES))
    step = F.floor(F.log2("n") * 16).cast("int")
    taken, least = 0, None
    for row in sorted(fit.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        taken += row["count"]
        if taken > most:
            break
        least = row["step"]
    return fit.where(step >= least) if least is not None else fit.limit(0)


def replayed(words: DataFrame, ranks: str) -> DataFrame:
    """``word, ids`` for every row of ``words``: each task replays the merges over its shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks)
        for batch in batches:
            if batch.num_rows:
                ids = replay(batch.column(0).to_pylist(), vocab)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word binary, ids binary")


def lexicon(docs: DataFrame, pattern: str, ranks: str, text_col: str = "text", most: int = LEXICON_WORDS) -> pa.Table:
    """``word, ids`` of the words that the corpus shares most; bounded, see ``LEXICON_WORDS``."""
    counts = stored(word_counts(docs, pattern, text_col).where("blocks > 1"), "words")
    return replayed(shared_words(counts, most), ranks).toArrow()


class Known:
    """Ids of words by hash: the shared lexicon, and what a task has replayed itself."""

    def __init__(self, table: pa.Table):
        words = table.column("word").combine_chunks()
        raw, offsets = W.utf8(words.cast(pa.large_binary()).view(pa.large_string()))
        hashes = W.hashed(raw, offsets[:-1], offsets[1:])
        ids = table.column("ids").combine_chunks().cast(pa.large_binary())
        flat, bounds = W.utf8(ids.view(pa.large_string()))
        order = np.argsort(hashes)
        self.given = hashes[order], flat.view("<u4"), bounds[:-1][order] // 4, bounds[1:][order] // 4
        self.mine: dict[int, bytes] = {}

    def ids_of(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray, vocab: Vocabulary):
        """Ids of distinct words in a row, and where each word's begin and end."""
        keys, flat, first, last = self.given
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        there = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
        begin, stop = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        begin[there], stop[there] = first[at[there]], last[at[there]]
        rest = np.flatnonzero(~there)
        names = hashes[rest].tolist()
        new = [k for k, name in enumerate(names) if name not in self.mine]
        if len(self.mine) + len(new) > KNOWN_WORDS:
            self.mine.clear()
            new = list(range(len(names)))
        data = raw.tobytes()
        words = [data[a:b] for a, b in zip(start[rest[new]].tolist(), end[rest[new]].tolist(), strict=True)]
        self.mine.update(zip([names[k] for k in new], replay(words, vocab), strict=True))
        own = [self.mine[name] for name in names]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        stop[rest] = len(flat) + np.cumsum(sizes)
        begin[rest] = stop[rest] - sizes
        return np.concatenate([flat, np.frombuffer(b"".join(own), "<u4")]) if own else flat, begin, stop


def encoded(
    docs: DataFrame,
    pattern: str,
    ranks: str,
    text_col: str = "text",
    shared: pa.Table | None = None,
    back: bool = False,
) -> DataFrame:
    """``row`` (the input columns), ``out.ids`` and ``out.bytes`` for every row of ``docs``.

    ``ids``: little-endian unsigned 32-bit integers in one binary value; ``bytes``: with
    ``back`` what the ids decode to, else null. ``shared``: a table of ``lexicon``; without one
    every task replays all words that it meets. A null or empty text has no ids (an empty
    value); repeated rows get equal ids; extra columns stay in ``row``. Words are told apart by
    a 64-bit hash; that the ids spell the text is checked for every block, so two words of one
    hash fail the job and never give wrong ids. A word of n bytes takes about 150 n bytes of
    memory while it is replayed.
    """
    empty = pa.table({"word": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    given = docs.sparkSession.sparkContext.broadcast(shared if shared is not None else empty)

    def compute() -> Callable[[pa.Array], pa.StructArray]:
        split, vocab, known = Splitter(pattern), vocabulary(ranks), Known(given.value)

        def block(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Ids of all texts in a row, how many each text has, and their bytes."""
            found = split_words(raw, offsets, split)
            hashes, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
            flat, begin, stop = known.ids_of(hashes, raw, found.start[first], found.end[first], vocab)
            ids = spread(flat, begin[which], stop[which])
            counts = np.r_[0, np.cumsum((stop - begin)[which])][found.first]
            spelled = vocab.decode(ids.astype(np.int64))
            if not np.array_equal(spelled, raw):
                raise ValueError("two words have the same hash")
            return ids, np.diff(counts), spelled

        def work(texts: pa.Array) -> pa.StructArray:
            done = [block(raw, offsets) for raw, offsets in parts(texts)]
            ids = np.concatenate([d[0] for d in done] or [np.zeros(0, "<u4")])
            sizes = np.concatenate([d[1] for d in done] or [np.zeros(0, np.int64)])
            if len(sizes) != len(texts):  # one long text in chunks
                sizes = np.array([sizes.sum()])
            values = [binaries(ids.view(np.uint8), 4 * sizes)]
            if back:
                lengths = np.diff(W.sizes(texts))
                values.append(binaries(np.concatenate([d[2] for d in done] or [np.zeros(0, np.uint8)]), lengths))
            else:
                values.append(pa.nulls(len(texts), pa.binary()))
            return pa.StructArray.from_arrays(values, names=["ids", "bytes"])

        return work

    return rows_with(docs, text_col, "ids binary, bytes binary", compute, W.BLOCK_BYTES)


def binaries(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of these sizes, side by side in ``raw``."""
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    large = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return large.cast(pa.binary())


def decoded(df: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """``row`` (the input columns) and ``out.bytes`` for every row of ``df``.

    Null ids give null bytes, no ids give empty bytes; an id that the rank file lacks, or a
    value that is no whole number of ids, fails the job.
    """

    def compute() -> Callable[[pa.Array], pa.StructArray]:
        vocab = vocabulary(ranks)

        def text(ids: bytes | None) -> bytes | None:
            return None if ids is None else vocab.decode(np.frombuffer(ids, "<u4").astype(np.int64)).tobytes()

        def work(values: pa.Array) -> pa.StructArray:
            return pa.StructArray.from_arrays(
                [pa.array([text(v.as_py()) for v in values], pa.binary())], names=["bytes"]
            )

        return work

    return rows_with(df, ids_col, "bytes binary", compute, W.BLOCK_BYTES)
