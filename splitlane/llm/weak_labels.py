"""Quality classifier from weak labels: overlapping heuristics, EM, hashed linear scorer.

Each labeller votes good, bad or abstains on a text by one ratio. Expectation-maximisation
over the counts of vote patterns (all texts; at most 3**6 patterns) estimates how often
each labeller gives which vote for good texts and for each kind of junk, and with that every
pattern's posterior. The posteriors of a bounded pick of texts train a logistic scorer on hashed
word shapes, which then scores every text, also where all labellers abstain.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm import words as W
from splitlane.llm.common import rows_with
from splitlane.llm.pii import shapes
from splitlane.llm.repetition import SYMBOL, per_text
from splitlane.llm.sampling import picked_rows

#: Texts that train the scorer.
TRAINING_TEXTS = 8_000
BUCKETS = 4096
STEPS = 150
THRESHOLD = 0.5
#: Share of good texts that a labeller calls bad, as assumed before seeing any.
FALSE_ALARM = 0.001
#: Share of its own kind of junk that a labeller calls bad, as assumed before seeing any.
OWN_BAD = 0.99
#: Texts that these two assumptions weigh.
PRIOR_TEXTS = 200

#: Words in which a word counts as seen before, so that the share does not grow with the text.
WINDOW = 1000
#: Words of a passage that count as seen before wherever in the text it was.
PASSAGE = 8

GOOD, BAD, ABSTAIN = 0, 1, 2
#: Labellers: ratio, good up to, bad from, fewest words to vote.
LABELLERS = (
    ("symbols", 0.01, 0.05, 1),  # of characters: # * $ % & | < >
    ("capitals", 0.20, 0.60, 3),  # of letters
    ("exclaimed", 0.05, 0.30, 3),  # of words: exclamation marks
    ("stutter", 0.03, 0.20, 5),  # of words: the same as the one before
    ("stale", 0.60, 0.75, 30),  # of words: seen before in the window, or in a passage seen before
    ("wordless", 0.10, 0.40, 3),  # of words: without any letter
)

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xF5)]] = True


def repeats(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """For every word whether it equals the one before, and whether it is stale: its window
    of ``WINDOW`` words had it before, or it is in ``PASSAGE`` words that its text had before."""
    text = found.text
    same = np.zeros(len(text), bool)
    same[1:] = (found.hash[1:] == found.hash[:-1]) & (text[1:] == text[:-1])
    own = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    window = ((np.arange(len(text)) - found.first[:-1][text]) // WINDOW).astype(np.uint64)
    _, first = np.unique(W.mix(found.hash + own + window * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)
    seen = np.ones(len(text), bool)
    seen[first] = False
    if found.count.max(initial=0) > WINDOW:  # else the window is the text
        inside = text[: len(text) - PASSAGE + 1] == text[PASSAGE - 1 :]
        inside &= (found.count > WINDOW)[text[: len(inside)]]
        start = np.flatnonzero(inside)
        passage = W.joined(found.hash, PASSAGE)[start]
        _, first = np.unique(W.mix(passage + own[start]), return_index=True)
        again = np.delete(start, first)
        step = np.zeros(len(text) + 1, np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + PASSAGE, -1)
        seen |= np.cumsum(step)[:-1] > 0
    return same, seen


def ratios(raw: np.ndarray, offsets: np.ndarray, found: W.Words) -> np.ndarray:
    """One row per text, one column per labeller."""
    same, seen = repeats(found)
    n = np.maximum(found.count, 1)
    letters = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LETTER[raw], out=letters[1:])
    chars = np.maximum(np.diff(offsets), 1)
    n_letters = np.diff(letters[offsets])
    wordless = letters[found.end] == letters[found.start]
    return np.stack(
        [
            per_text(SYMBOL[raw], offsets) / chars,
            per_text(_UPPER[raw], offsets) / np.maximum(n_letters, 1),
            per_text(raw == 0x21, offsets) / n,
            per_text(same, found.first) / n,
            per_text(seen, found.first) / n,
            per_text(wordless, found.first) / n,
        ],
        axis=1,
    )


def votes(values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    out = np.full(values.shape, ABSTAIN)
    for k, (_, good, bad, fewest) in enumerate(LABELLERS):
        enough = n_words >= fewest
        out[enough & (values[:, k] <= good), k] = GOOD
        out[enough & (values[:, k] >= bad), k] = BAD
    return out


def buckets(raw: np.ndarray, found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and value of the hashed features: square roots of shares of the words."""
    (mask, digits, ends, sized), _ = shapes(raw, found)
    same, seen = repeats(found)
    flags = same.astype(np.int64) * 2 + seen
    text = found.text
    keys = []
    for name, feature in enumerate((mask * 4 + flags, (ends * 28 + sized) * 4 + flags)):
        spot = W.mix(feature.astype(np.uint64) + np.uint64((name + 1) << 40)) % np.uint64(BUCKETS)
        keys.append(text * BUCKETS + spot.astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    owner = key // BUCKETS
    return owner, key % BUCKETS, np.sqrt(count / found.count[owner])


class VoteModel:
    """Good texts and some kinds of junk, fitted to vote patterns by EM.

    Each kind belongs to a labeller that calls it bad; how the others vote on it is learned, and
    so is how often each labeller calls a good text bad. Votes are independent given the kind;
    abstaining says nothing. The kinds cover the texts with a bad vote: the labeller that calls
    most of those left bad comes next, until fewer than ``FALSE_ALARM`` of all texts are left.
    So junk that one labeller alone sees is a kind as any other, while a lone bad vote of a
    labeller whose finds several others share may be overruled. The prior weighs
    ``PRIOR_TEXTS`` texts, whatever the size of the corpus.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 5000):
        n = patterns.shape[1]
        self.cast = (patterns[:, :, None] == np.array([GOOD, BAD])).astype(float)
        self.counts = counts
        bad = self.cast[:, :, 1]
        left = bad.any(1)
        #: Labeller of each kind of junk.
        self.kinds: list[int] = []
        while counts[left].sum() > FALSE_ALARM * counts.sum():
            self.kinds.append(int((counts[left] @ bad[left]).argmax()))
            left &= bad[:, self.kinds[-1]] == 0
        self.prior = np.ones((len(self.kinds) + 1, n, 2))
        self.prior[0] = PRIOR_TEXTS * np.array([1 - FALSE_ALARM, FALSE_ALARM])
        for kind, labeller in enumerate(self.kinds, 1):
            self.prior[kind, labeller] = PRIOR_TEXTS * np.array([1 - OWN_BAD, OWN_BAD])
        own = bad[:, self.kinds].T
        seen = own.sum(0)
        self.member = np.vstack([np.where(seen > 0, 0.1, 1), 0.9 * own / np.maximum(seen, 1)])
        #: Logarithm of likelihood times prior after each round.
        self.fits: list[float] = []
        for _ in range(rounds):
            before = self.member
            self._maximise()
            self.fits.append(self._expect())
            if np.abs(self.member - before).max() < 1e-7:
                break

    def _maximise(self) -> None:
        weight = self.member * self.counts
        self.share = (weight.sum(1) + 1) / (weight.sum() + len(weight))
        table = np.einsum("cp,plv->clv", weight, self.cast) + self.prior
        self.table = table / table.sum(2, keepdims=True)

    def _expect(self) -> float:
        log = np.log(self.share)[:, None] + np.einsum("clv,plv->cp", np.log(self.table), self.cast)
        top = log.max(0)
        total = np.log(np.exp(log - top).sum(0)) + top
        self.member = np.exp(log - total)
        return float(self.counts @ total + np.log(self.share).sum() + (self.prior * np.log(self.table)).sum())


def accuracies(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior probability of "good" for every vote pattern, by EM."""
    return VoteModel(patterns, counts).member[0]


class Scorer:
    """A logistic model over hashed buckets."""

    def __init__(self):
        self.weight = np.zeros(BUCKETS)
        self.bias = 0.0

    def __call__(self, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(owner, self.weight[bucket] * value, n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = STEPS) -> None:
        owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
        bucket = np.concatenate([b for b, _ in rows])
        value = np.concatenate([v for _, v in rows])
        first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for step in range(1, steps + 1):
            error = self(owner, bucket, value, len(rows)) - target
            grad = np.r_[np.bincount(bucket, error[owner] * value, BUCKETS), error.sum()] / len(rows)
            grad[:-1] += 1e-5 * self.weight
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            move = 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
            self.weight -= move[:-1]
            self.bias -= move[-1]


def _pieces(texts: pa.Array):
    raw, offsets = W.utf8(texts)
    for i, j in W.blocks(offsets):
        part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield part, own, W.split(part, own, W.NOT_SPACE)


def _pattern(cast: np.ndarray) -> np.ndarray:
    return cast @ (3 ** np.arange(cast.shape[1]))


def _unpacked(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def _voting(with_features: bool) -> Callable[[], Callable[[pa.Array], pa.StructArray]]:
    def work(texts: pa.Array) -> pa.StructArray:
        pattern, n_words, bucket, value = [], [], [], []
        for raw, own, found in _pieces(texts):
            pattern.append(_pattern(votes(ratios(raw, own, found), found.count)))
            n_words.append(found.count)
            if with_features:
                owner, b, v = buckets(raw, found)
                cut = np.searchsorted(owner, np.arange(1, len(own) - 1))
                bucket += np.split(b, cut)
                value += np.split(v, cut)
            else:
                bucket += [None] * (len(own) - 1)
                value += [None] * (len(own) - 1)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(pattern), pa.int64()),
                pa.array(np.concatenate(n_words), pa.int64()),
                pa.array(bucket, pa.list_(pa.int64())),
                pa.array(value, pa.list_(pa.float64())),
            ],
            names=["pattern", "n_words", "bucket", "value"],
        )

    return lambda: work


VOTES = "pattern long, n_words long, bucket array<long>, value array<double>"


def train(docs: DataFrame, text_col: str = "text", texts: int = TRAINING_TEXTS) -> tuple[dict[int, float], Scorer]:
    """Posterior of "good" by vote pattern (all texts), and the scorer (about ``texts`` texts)."""
    narrow = docs.select(F.col(text_col).alias("text"))
    voted = rows_with(narrow, "text", VOTES, _voting(False)).where("out.n_words > 0")
    rows = voted.groupBy("out.pattern").count().collect()
    scorer = Scorer()
    if not rows:
        return {}, scorer
    pattern = np.array([r["pattern"] for r in rows], np.int64)
    good = accuracies(_unpacked(pattern), np.array([r["count"] for r in rows], float))
    posterior = dict(zip(pattern.tolist(), good.tolist(), strict=True))
    sample = rows_with(
        picked_rows(docs, texts).select(F.col(text_col).alias("text")), "text", VOTES, _voting(True)
    ).where("out.n_words > 0").select("out.pattern", "out.bucket", "out.value").collect()
    if sample:
        target = np.array([posterior[r["pattern"]] for r in sample])
        scorer.fit([(np.array(r["bucket"]), np.array(r["value"])) for r in sample], target)
    return posterior, scorer


def quality(docs: DataFrame, text_col: str = "text", texts: int = TRAINING_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (the input columns) and ``out`` for every row of ``docs``.

    ``out``: ``n_words``; ``weak``, the posterior of the labellers' votes; ``score`` of the
    linear scorer; ``kept`` (score of at least ``threshold``). A null or empty text, or one
    of white space, has score 0 and is rejected. Equal texts get equal scores.
    """
    posterior, scorer = train(docs, text_col, texts)

    def compute() -> Callable[[pa.Array], pa.StructArray]:
        def work(batch: pa.Array) -> pa.StructArray:
            n_words, weak, score = [], [], []
            for raw, own, found in _pieces(batch):
                pattern = _pattern(votes(ratios(raw, own, found), found.count))
                weak += [posterior.get(p, 0.0) if n else 0.0 for p, n in zip(pattern.tolist(), found.count.tolist(), strict=True)]
                score.append(np.where(found.count > 0, scorer(*buckets(raw, found), len(own) - 1), 0.0))
                n_words.append(found.count)
            total = np.concatenate(score)
            return pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(n_words), pa.int64()),
                    pa.array(weak, pa.float64()),
                    pa.array(total, pa.float64()),
                    pa.array((total >= threshold) & (np.concatenate(n_words) > 0), pa.bool_()),
                ],
                names=["n_words", "weak", "score", "kept"],
            )

        return work

    return rows_with(docs, text_col, "n_words long, weak double, score double, kept boolean", compute)
