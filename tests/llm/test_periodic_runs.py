"""Periodic runs against a search of all periods in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlane.llm.periodic_runs import WaveletMatrix, find_runs, periodic_runs, with_periods
from splitlane.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=12):
    """Every maximal stretch of equal distance, kept with its smallest period."""
    n, found = len(w), {}
    numbers = {x: i for i, x in enumerate(dict.fromkeys(w))}
    t = np.array([numbers[x] for x in w])
    for q in range(1, n // 2 + 1):
        same = np.r_[False, t[q:] == t[:-q], False].astype(int)
        opens, closes = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
            if b - a + q >= max(least, 2 * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((a, size, q) for (a, size), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def test_wavelet_matrix_counts_and_selects():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 500):
        values = rng.permutation(n)
        matrix = WaveletMatrix(values, n)
        low = rng.integers(0, n, 200)
        high = low + 1 + rng.integers(0, n, 200) % (n - low)
        x = rng.integers(0, n + 1, 200)
        k = rng.integers(0, n, 200) % (high - low)
        parts = [np.sort(values[a:b]) for a, b in zip(low, high, strict=True)]
        assert matrix.below(low, high, x).tolist() == [int((p < y).sum()) for p, y in zip(parts, x, strict=True)]
        assert matrix.smallest(low, high, k).tolist() == [int(p[j]) for p, j in zip(parts, k, strict=True)]


def texts():
    rng = random.Random(7)
    out = ["a" * n for n in (0, 1, 11, 12, 13, 200)]
    out += ["".join(rng.choice("ab"[:k] + "c" * (j % 2)) for _ in range(rng.randint(1, 150))) for k in (1, 2) for j in range(200)]
    for _ in range(300):  # powers, nested powers, and one letter changed
        unit = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        inner = unit * rng.randint(1, 6) + rng.choice("abxy")
        text = list("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) + inner * rng.randint(1, 6) + unit[:3])
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = "z"
        out.append("".join(text))
    a, b = "abab" * 10, "b" + "ab" * 12  # two runs of one period that meet out of step
    return [*out, a + "a" + a, b + b, b + "a" + b[::-1], "abcabcab" * 8, ("ab" * 9 + "a") * 2 + "bab"]


def test_all_runs_of_many_texts_are_found():
    for text in texts():
        t = np.unique(list(text), return_inverse=True)[1] if text else np.zeros(0, np.int64)
        assert [tuple(r) for r in find_runs(t, len(t)).tolist()] == brute(list(text)), text


def test_odd_rows(spark, odd_docs, no_docs):
    extra = [(200 + i, " ".join(t) or "\n", "en", "s", 1, "k", "c") for i, t in enumerate(texts()[::7])]
    extra.append((999, "x y z " * 40_000, "en", "s", 1, "k", "c"))
    docs = odd_docs.unionByName(spark.createDataFrame(extra, odd_docs.schema))
    rows = periodic_runs(docs).select("row.*", "out.*").collect()
    assert len(rows) == docs.count()
    for row in rows:
        w = words(row.text)
        wanted = brute(w) if len(w) < 50_000 else [(0, 120_000, 3)]
        assert row.n_words == len(w)
        assert [(r.start, r.length, r.period) for r in row.runs] == wanted
        assert row.collapsed == collapsed(w, wanted)
    assert periodic_runs(no_docs).count() == 0


def test_rebuilt_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(i, t) for i in range(1000, 1300) for t in ("one", "a  b", None, " \n")], docs.schema))
    found = docs.select("doc_id", "text", with_periods(F.col("doc_id"), F.col("text")).alias("new")).collect()
    assert all(words(r.new) == planted(r.doc_id, words(r.text)) for r in found)
    assert sum(r.new != r.text for r in found if r.new) > 20


@pytest.mark.parametrize("sf_dir", [SF])
def test_query(spark, sf_dir):
    found = {r.doc_id: r for r in QUERIES["op12_periodic_runs"].run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        w = planted(d.doc_id, words(d.text))
        runs, row = brute(w), found[d.doc_id]
        assert row.n_runs == len(runs)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        if best is None:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (*best, 1000 * best[1] // best[2])
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
