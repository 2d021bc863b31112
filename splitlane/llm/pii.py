"""Personal data: fixed forms, and a linear-chain conditional random field beside them.

The field sees a word as its shape only: which kinds of characters it has, how many
digits, how it begins and ends, how long it is, and the same of both neighbours. A line is
a sequence. It is trained here, by full-batch gradient steps on the exact likelihood, from
a small table of texts with labelled spans. Decoding is Viterbi over batches of lines.
A line needs decoding only if some word could gain from a label: where every word prefers
"none" by more than two transitions can give back, the unlabelled path is the best one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm import words as W
from splitlane.llm.common import rows_with
from splitlane.llm.pii_base import KINDS, base_spans
from splitlane.llm.sampling import picked_rows

#: Texts with a base span that the default labelled table takes at most.
LABELLED_TEXTS = 200
#: Words on both sides of a labelled span that training sees.
CONTEXT = 3
STEPS = 60
#: Bytes of text that the field sees at once, cut at line ends, where sequences end too; a longer
#: line is handled alone. Lines that Viterbi steps through together, at most.
PIECE_BYTES = 1 << 18
MOST_LINES = 1 << 13
#: How spelled-out addresses of the training texts are written, without any digit.
SPELLED = ((" [at] ", False), (" [at] ", True), (" (at) ", False), (" (at) ", True))
#: By how much the labels of an address of up to three words without @ and digits must lead,
#: unless it has a spelled-out sign; longer ones in proportion.
LEAST_MARGIN = 2.0

TAGS = ["none"] + [f"{part}-{kind}" for kind in KINDS for part in ("first", "next")]
K = len(TAGS)

SPAN = "struct<kind:string,start:long,end:long,base:boolean>"

# Character classes; every byte of a letter outside ASCII counts as lower case.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
for _k, _chars in enumerate(("@", ".", "+", "()", "-"), 3):
    _CLASS[[ord(c) for c in _chars]] = _k
_BIT = np.array([1 << c for c in _CLASS], np.int64)
_DIGITS = np.array([0, 1, 2, 3, 4, 5, 5, 5, *[6] * 8, 7, 8, 8, 8, 9])
_LENGTHS = np.array([0, 0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4, *[5] * 8, 6])
_DIGIT = np.array([0x30 <= b < 0x3A for b in range(256)])
_AT_OR_DIGIT = _DIGIT | (np.arange(256) == 0x40)

#: Sizes of the features of one word: classes present, digits, first and last, length and dots.
SIZES = (512, 10, 81, 7 * 4)
#: Feature and place (word before, itself, word after); one more value stands for no word.
TEMPLATES = [(f, d) for f in range(3) for d in (-1, 0, 1)] + [(3, 0)]


def shapes(raw: np.ndarray, found: W.Words) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature values of every word, and the words that begin a line."""
    n = len(found.start)
    lines = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 0x0A, out=lines[1:])
    line = lines[found.start]
    begins = np.ones(n, bool)
    begins[1:] = (line[1:] != line[:-1]) | (found.text[1:] != found.text[:-1])
    if not n:
        return [np.zeros(0, np.int64)] * len(SIZES), begins
    cuts = np.stack([found.start, found.end], axis=1).ravel()
    closed = np.minimum(cuts, len(raw) - 1)  # the last end may be the block's end

    def over(values: np.ndarray, how) -> np.ndarray:
        out = how.reduceat(values, closed)[::2]
        if cuts[-1] == len(raw):  # the last word reaches the end: reduce it alone
            out[-1] = how.reduce(values[found.start[-1] :])
        return out

    mask = over(_BIT[raw], np.bitwise_or)
    digits = over(_DIGIT[raw].astype(np.int64), np.add)
    dots = over((raw == 0x2E).astype(np.int64), np.add)
    length = found.end - found.start
    ends = _CLASS[raw[found.start]].astype(np.int64) * 9 + _CLASS[raw[found.end - 1]]
    sized = _LENGTHS[np.minimum(length, len(_LENGTHS) - 1)] * 4 + np.minimum(dots, 3)
    return [mask, _DIGITS[np.minimum(digits, len(_DIGITS) - 1)], ends, sized], begins


def placed(values: list[np.ndarray], begins: np.ndarray) -> list[np.ndarray]:
    """A feature index per template and word."""
    out = []
    last = np.r_[begins[1:], True] if len(begins) else begins
    for f, d in TEMPLATES:
        index = values[f]
        if d == -1:
            index = np.r_[0, index[:-1]] if len(index) else index
            index = np.where(begins, SIZES[f], index)
        elif d == 1:
            index = np.r_[index[1:], 0] if len(index) else index
            index = np.where(last, SIZES[f], index)
        out.append(index)
    return out


class Crf:
    """Weights per template and tag, and of tag pairs."""

    def __init__(self):
        self.weights = [np.zeros((SIZES[f] + 1, K)) for f, _ in TEMPLATES]
        self.pairs = np.zeros((K, K))

    def scores(self, index: list[np.ndarray]) -> np.ndarray:
        return sum(w[i] for w, i in zip(self.weights, index, strict=True))

    def fit(self, index: list[np.ndarray], real: np.ndarray, tags: np.ndarray, steps: int = STEPS) -> None:
        """``index``: per template an array of sequences by places; ``real``: which places count."""
        rate, l2 = 0.2, 1e-3
        n = max(1, len(real))
        params = [*self.weights, self.pairs]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        gold = np.eye(K)[tags] * real[:, :, None]
        both = (real[:, :-1] & real[:, 1:])[:, :, None, None]
        gold_pairs = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * both).sum((0, 1))
        for step in range(1, steps + 1):
            marginal, pair = self._expected(self.scores(index), real)
            error = marginal - gold
            grads = []
            for w, i in zip(self.weights, index, strict=True):
                at, e = i[real], error[real]
                grads.append(np.stack([np.bincount(at, e[:, k], len(w)) for k in range(K)], axis=1))
            grads.append(pair - gold_pairs)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g / n + l2 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def _expected(self, emit: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag marginals and expected pair counts, by scaled forward and backward products."""
        count, places, _ = emit.shape
        there = real[:, :, None]
        weight = np.where(there, np.exp(emit - emit.max(2, keepdims=True)), 1.0)
        step = np.exp(self.pairs)
        fore, back = np.empty_like(weight), np.ones_like(weight)
        fore[:, 0] = weight[:, 0] / weight[:, 0].sum(1, keepdims=True)
        for t in range(1, places):
            go = (fore[:, t - 1] @ step) * weight[:, t]
            fore[:, t] = np.where(there[:, t], go / go.sum(1, keepdims=True), fore[:, t - 1])
        for t in range(places - 2, -1, -1):
            go = (weight[:, t + 1] * back[:, t + 1]) @ step.T
            back[:, t] = np.where(there[:, t + 1], go / go.sum(1, keepdims=True), 1.0)
        marginal = fore * back
        marginal = marginal / marginal.sum(2, keepdims=True) * there
        pair = np.zeros((K, K))
        for t in range(places - 1):
            right = weight[:, t + 1] * back[:, t + 1]
            total = ((fore[:, t] @ step) * right).sum(1, keepdims=True)
            pair += (fore[:, t] * there[:, t + 1] / total).T @ right
        return marginal, pair * step

    def decode(self, index: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
        """The best tag of every word; lines begin at ``begins``."""
        tags = np.zeros(len(begins), np.int64)
        if not len(begins):
            return tags
        emit = self.scores(index)
        margin = emit[:, 0] - emit[:, 1:].max(1)
        gain = max(0.0, float(self.pairs.max() - self.pairs[0, 0]))
        line = np.cumsum(begins) - 1
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.r_[starts, len(begins)])
        todo = np.unique(line[margin <= 2 * gain])
        todo = todo[np.argsort(sizes[todo], kind="stable")]
        at = 0
        while at < len(todo):  # batches of like lengths, bounded in padded words
            longest, end = 0, at
            most = min(len(todo), at + MOST_LINES)
            while end < most and (end - at + 1) * sizes[todo[end]] <= max(200_000, sizes[todo[at]]):
                longest = sizes[todo[end]]
                end += 1
            self._viterbi(emit, starts[todo[at:end]], sizes[todo[at:end]], int(longest), tags)
            at = end
        return tags

    def _viterbi(self, emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: int, tags: np.ndarray) -> None:
        count = len(starts)
        score = emit[starts]
        came = np.zeros((places, count, K), np.int8)
        for t in range(1, places):
            live = np.flatnonzero(sizes > t)
            step = score[live, :, None] + self.pairs
            came[t, live] = step.argmax(1)
            score[live] = step.max(1) + emit[starts[live] + t]
        tag = score.argmax(1)
        for t in range(places - 1, -1, -1):
            live = np.flatnonzero(sizes > t)
            tags[starts[live] + t] = tag[live]
            if t:
                tag[live] = came[t, live, tag[live]]


def places_of(raw: np.ndarray) -> np.ndarray:
    """The code point that each byte belongs to (and one place more)."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


_SIGN = re.compile(r"\w\s*[\[({<]\s*at\s*[\])}>]\s*\w", re.I)
_LETTERED = str.maketrans("0123456789", "abcdefghij")


def _spelled(address: str, sign: str, plain: bool) -> str:
    """An address with letters for its digits and a spelled-out sign; ``plain``: short too."""
    name, host = address.translate(_LETTERED).split("@", 1)
    if plain:
        name = name.replace(".", "")
        host = host.split(".", 1)[1] if host.count(".") > 1 else host
    return name + sign + host


def variants(
    text: str, spans: list[tuple[str, int, int]], spelled: tuple[str, bool] | None = None
) -> tuple[str, list[tuple[str, int, int]]] | None:
    """The text with its data written in looser forms, and where they are; none if unchanged."""
    forms = {
        "phone": lambda s: s.split(" ", 1)[1] if " " in s else s[1:],
        "email": lambda s: _spelled(s, *spelled) if spelled else s.replace("@", " [at] "),
        "card": lambda s: ".".join(s[i : i + 4] for i in range(0, len(s), 4)),
        "ip": lambda s: s,
    }
    out, new, at = [], [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < at:
            continue
        out.append(text[at:a])
        form = forms[kind](text[a:b])
        begin = sum(map(len, out))
        out.append(form)
        new.append((kind, begin, begin + len(form)))
        at = b
    changed = "".join([*out, text[at:]])
    return (changed, new) if changed != text else None


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS) -> Crf:
    """A field from texts with labelled spans; without examples it labels nothing."""
    crf = Crf()
    crf.weights[-1][:, 0] += 1.0  # before any evidence a word has no label
    rows: list[tuple[list[np.ndarray], np.ndarray]] = []
    for text, spans in examples:
        raw, offsets = W.utf8(pa.array([text]))
        found = W.split(raw, offsets, W.NOT_SPACE)
        values, begins = shapes(raw, found)
        index = placed(values, begins)
        place = places_of(raw)
        start, end = place[found.start], place[found.end]
        tags = np.zeros(len(start), np.int64)
        for kind, a, b in spans:
            hit = np.flatnonzero((start < b) & (end > a))
            tags[hit] = 2 + 2 * KINDS.index(kind)
            tags[hit[:1]] -= 1
        near = np.zeros(len(tags), bool)
        for i in np.flatnonzero(tags):
            near[max(0, i - CONTEXT) : i + CONTEXT + 1] = True
        odd = np.flatnonzero((values[1] > 0) & (tags == 0)) if len(tags) else []
        for i in [*odd[:8], *range(0, len(tags), 211)]:
            near[max(0, i - CONTEXT) : i + CONTEXT + 1] = True
        line = np.cumsum(begins)
        use = np.flatnonzero(near)
        pieces = np.split(use, np.flatnonzero((np.diff(use) != 1) | (np.diff(line[use]) != 0)) + 1) if len(use) else []
        rows += [([i[p[k : k + 24]] for i in index], tags[p[k : k + 24]]) for p in pieces for k in range(0, len(p), 24)]
    if not rows:
        return crf
    places = max(len(t) for _, t in rows)
    real = np.zeros((len(rows), places), bool)
    tags = np.zeros((len(rows), places), np.int64)
    index = [np.zeros((len(rows), places), np.int64) for _ in TEMPLATES]
    for r, (i, t) in enumerate(rows):
        real[r, : len(t)] = True
        tags[r, : len(t)] = t
        for whole, own in zip(index, i, strict=True):
            whole[r, : len(t)] = own
    crf.fit(index, real, tags, steps)
    return crf


def labelled_table(docs: DataFrame, text_col: str = "text", bound: int = LABELLED_TEXTS) -> DataFrame:
    """``text`` and ``spans`` of at most ``bound`` texts with base spans, in hash order.

    They come from about ``50 * bound`` rows picked by hash, whatever the size of ``docs``.
    """
    found = personal_data(picked_rows(docs, 50 * bound), text_col, crf=None).where(F.size("out.spans") > 0)
    text = F.col("row").getField(text_col)
    return (
        found.select(text.alias("text"), F.col("out.spans").alias("spans"))
        .orderBy(F.xxhash64("text"))
        .limit(bound)
    )


def train_from(table: DataFrame, steps: int = STEPS) -> Crf:
    """A field from a small labelled table, with looser forms of its spans added."""
    examples = []
    for row in table.collect():
        spans = [(s["kind"], s["start"], s["end"]) for s in row["spans"]]
        examples.append((row["text"], spans))
        looser = variants(row["text"], spans)
        if looser:
            examples.append(looser)
        mails = [x for x in spans if x[0] == "email"]
        for form in SPELLED if mails else ():
            examples.append(variants(row["text"], mails, form))
    return train(examples, steps)


def added_spans(raw: np.ndarray, found: W.Words, crf: Crf) -> list[tuple[int, str, int, int]]:
    """``(text, kind, first byte, end byte)`` of every run of labelled words."""
    return [run[:4] for run in labelled_runs(raw, found, crf)]


def labelled_runs(raw: np.ndarray, found: W.Words, crf: Crf) -> list[tuple[int, str, int, int, int, float]]:
    """``(text, kind, first byte, end byte, words, margin)`` of every run of labelled words.

    The margin is what the best path scores above the same path without the run.
    """
    values, begins = shapes(raw, found)
    index = placed(values, begins)
    tags = crf.decode(index, begins)
    hits = np.flatnonzero(tags)
    runs: list[tuple[str, int, int]] = []
    for i in hits.tolist():
        kind, first = KINDS[(tags[i] - 1) // 2], tags[i] % 2 == 1
        if not first and runs and runs[-1][0] == kind and runs[-1][2] == i and not begins[i]:
            runs[-1] = (kind, runs[-1][1], i + 1)
        else:
            runs.append((kind, i, i + 1))
    emit = np.zeros((len(tags), K))
    emit[hits] = crf.scores([i[hits] for i in index])
    out = []
    for kind, i, j in runs:
        before = [] if begins[i] else [tags[i - 1]]
        after = [] if j == len(tags) or begins[j] else [tags[j]]
        path, none = [*before, *tags[i:j], *after], [*before, *[0] * (j - i), *after]
        margin = sum(emit[q, tags[q]] - emit[q, 0] for q in range(i, j))
        margin += crf.pairs[path[:-1], path[1:]].sum() - crf.pairs[none[:-1], none[1:]].sum()
        out.append((int(found.text[i]), kind, int(found.start[i]), int(found.end[j - 1]), j - i, float(margin)))
    return out


def runs_by_piece(raw: np.ndarray, offsets: np.ndarray, crf: Crf) -> Iterator[tuple[int, str, int, int, int, float]]:
    """``labelled_runs`` of a block of texts, in pieces of ``PIECE_BYTES``."""
    borders = np.union1d(offsets, np.flatnonzero(raw == 0x0A) + 1)
    for i, j in W.blocks(borders, PIECE_BYTES):
        a, b = int(borders[i]), int(borders[j])
        text = int(np.searchsorted(offsets, a, "right")) - 1
        own = np.r_[a, offsets[(offsets > a) & (offsets < b)], b] - a
        part = raw[a:b]
        for t, kind, first, end, n, margin in labelled_runs(part, W.split(part, own, W.NOT_SPACE), crf):
            yield text + t, kind, a + first, a + end, n, margin


def _strong(part: str) -> bool:
    return any(c.isdigit() or c == "@" for c in part)


def rests(text: str, a: int, b: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of a decoded span outside base spans: those with a digit or @, and those whose
    letters run on into a base span."""
    out, at = [], a
    for x, y in [*sorted(s for s in base if s[0] < b and a < s[1]), (b, b)]:
        if x > at:
            p, q = _trimmed(text, at, x)
            runs_on = (p == at > a) or (q == x < b)
            if p < q and (_strong(text[p:q]) or runs_on):
                out.append((p, q))
        at = max(at, y)
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlaps are one."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def finder(crf: Crf | None, mask: bool) -> Callable[[], Callable[[pa.Array], pa.StructArray]]:
    span = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    )

    def compute() -> Callable[[pa.Array], pa.StructArray]:
        def work(texts: pa.Array) -> pa.StructArray:
            spans: list[list[dict]] = []
            clean: list[str | None] = []
            raw, offsets = W.utf8(texts)
            for i, j in W.blocks(offsets):
                part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                sums = np.zeros(len(part) + 1, np.int64)
                np.cumsum(_AT_OR_DIGIT[part], out=sums[1:])
                likely = np.diff(sums[own]) > 0
                more: dict[int, list[tuple[str, int, int, bool]]] = {}
                if crf is not None:
                    for t, kind, a, b, n, margin in runs_by_piece(part, own, crf):
                        sure = kind == "email" and n > 1 and margin >= LEAST_MARGIN * max(1, n / 3)
                        more.setdefault(t, []).append((kind, a - int(own[t]), b - int(own[t]), sure))
                for t in range(j - i):
                    if not likely[t] and t not in more:
                        spans.append([])
                        clean.append(texts[i + t].as_py() if mask else None)
                        continue
                    text = texts[i + t].as_py()
                    found = [(k, a, b, True) for k, a, b in base_spans(text)]
                    if t in more:
                        place = places_of(part[own[t] : own[t + 1]])
                        base = [(x, y) for _, x, y, _ in found]
                        for kind, a, b, sure in more[t]:
                            a, b = _trimmed(text, int(place[a]), int(place[b]))
                            if any(a < y and x < b for x, y in base):
                                found += [(kind, x, y, False) for x, y in rests(text, a, b, base)]
                            elif sure or _strong(text[a:b]) or (kind == "email" and _SIGN.search(text, a, b)):
                                found.append((kind, a, b, False))
                    found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                    spans.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in found])
                    clean.append(masked(text, [s[:3] for s in found]) if mask else None)
            return pa.StructArray.from_arrays(
                [pa.array(spans, span), pa.array(clean, pa.string())], names=["spans", "clean"]
            )

        return work

    return compute


def personal_data(docs: DataFrame, text_col: str = "text", crf: Crf | None = None, mask: bool = False) -> DataFrame:
    """``row`` (the input columns) and ``out`` for every row of ``docs``.

    ``out.spans``: kind, start and end (code points, end exclusive), and whether it is a
    base span, by kind as listed, then start. Spans of ``crf`` are added where they hold a
    digit or @, and spelled-out addresses of several words by ``LEAST_MARGIN``; of a span that
    overlaps base spans, the parts outside them that hold a digit or @ or run on into one. ``out.clean``: with ``mask`` the text with spans
    replaced by their kind, else null. Null and empty texts have no spans (a null text
    stays null); repeated rows get equal results.
    """
    return rows_with(docs, text_col, f"spans array<{SPAN}>, clean string", finder(crf, mask), W.BLOCK_BYTES)


def redacted(docs: DataFrame, crf: Crf, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with masked texts; ``length_col`` (if there) follows. Same columns."""
    clean = F.col("out.clean")
    new = {text_col: clean, length_col: F.char_length(clean).cast("long")}
    return personal_data(docs, text_col, crf, mask=True).select(
        *[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    )
