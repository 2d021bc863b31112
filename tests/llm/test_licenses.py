"""The license scan against word comparisons of every license text with whole blocks."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from splitlane.llm import licenses
from splitlane.llm.licenses import KNOWN, LEAST_REDUCTION, Scanner, anchors, blocks, license_scan, pieces, scanning, stretches, words_of

RNG = random.Random(11)
PROSE = ["".join(RNG.choice("abdeilnorst") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def altered(words, most):
    words = list(words)
    for _ in range(RNG.randint(0, most)):
        spot, kind = RNG.randrange(len(words)), RNG.randrange(3)
        words[spot : spot + (kind < 2)] = [RNG.choice(PROSE)] if kind else []
    return words


def everything(scan, block):
    """Confirmed finds with every license text held against the whole block, nothing ranked."""
    found = [
        (len(words) - apart, k, apart, a, b)
        for k, (_, words, _, _, most) in enumerate(scan.known)
        for apart, a, b in stretches(words, block, most)
    ]
    used, out = set(), set()
    for _, k, apart, a, b in sorted(found, key=lambda f: (-f[0], f[1], f[3])):
        name = scan.known[k][0]
        if not any((name, j) in used for j in range(a, b)):
            used.update((name, j) for j in range(a, b))
            out.add((name, a, b, apart))
    return out


def test_ranked_finds_equal_the_comparison_with_every_text():
    scan = Scanner(KNOWN)
    for trial in range(600):
        k = trial % len(scan.known)
        parts = [RNG.choices(PROSE, k=RNG.choice([0, 5, 60, 200])), altered(scan.known[k][1], scan.known[k][4])]
        parts.append(RNG.choices(PROSE, k=RNG.choice([0, 5, 60])))
        if trial % 2:
            parts.insert(RNG.randrange(4), RNG.choice(scan.known)[1])
        block = sum(parts, [])
        marks = [i for i, w in enumerate(block) if w in scan.anchors]
        got = {(f[0], f[1], f[2], f[4]) for f in scan(block, marks) if f[6]}
        assert got == everything(scan, block)


def test_whole_tables_give_what_the_comparison_gives():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks().cast("string")
    scan, found = Scanner(KNOWN), scanning(KNOWN)()(texts).to_pylist()
    hits = 0
    for text, row in zip(texts.to_pylist(), found, strict=True):
        words, first, _ = words_of(text or "")
        got = {(f["license"], f["start"], f["differences"]) for f in row["found"] if f["confirmed"]}
        assert got == {(name, int(first[a]), apart) for name, a, _, apart in everything(scan, words)}
        hits += len(got)
    assert hits > 20


def test_without_savings_nothing_is_found(monkeypatch):
    text = pa.array([text for _, text in KNOWN])
    assert all(r["found"] for r in scanning(KNOWN)()(text).to_pylist())
    monkeypatch.setattr(Scanner, "_saved", lambda self, words, which: [0.0] * len(which))
    assert not any(r["found"] for r in scanning(KNOWN)()(text).to_pylist())


def test_the_nearer_text_saves_more_and_ranks_first():
    scan = Scanner(KNOWN)
    for k, (name, words, *_) in enumerate(scan.known):
        if len(words) >= 10:
            piece = [*RNG.choices(PROSE, k=30), *altered(words, 2 * scan.known[k][4]), *RNG.choices(PROSE, k=30)]
            assert scan.known[scan.ranked(piece)[0]][0] == name
            assert scan._saved(piece, [k])[0] > 2 * LEAST_REDUCTION
    assert scan.ranked(PROSE[:300]) == []


@pytest.mark.parametrize("most", [0, 1, 4])
def test_an_anchor_survives_and_pieces_hold_every_stretch(most):
    words = [f"w{'x' * (k % 7)}{k}" for k in range(10 * max(most, 1))]
    chosen = set(anchors(words, most))
    for _ in range(200):
        assert most == 0 or chosen & set(altered(words, most))
    assert len(chosen) == most + 1
    for n in (1, 5, 39, 40, 41, 500):
        cut = pieces(n, 10)
        assert all(any(a <= i and min(i + 10, n) <= b for a, b in cut) for i in range(max(n - 9, 1)))
        assert max(b - a for a, b in cut) <= licenses.PIECE * 10
    assert blocks([(3, 4), (5, 6), (40, 41)], 45, 4) == [(0, 10), (36, 45)]


def test_own_texts_need_no_cue_word_and_identifiers_are_told_apart(spark):
    plain = "This program comes with absolutely no warranty; for details look at the file beside it."
    docs = spark.createDataFrame([(1, "ab cd. " + plain), (2, None), (3, "# SPDX-License-Identifier: ISC\nint x;"), (4, "")], "id long, text string")
    own = {r.id: r.found for r in license_scan(docs, "text", [("X", plain), ("empty", "...")]).select("row.id", "out.found").collect()}
    assert [(f["license"], f["start"], f["confirmed"]) for f in own[1]] == [("X", 7, True)] and not own[2] and not own[4]
    all_known = {r.id: r.found for r in license_scan(docs).select("row.id", "out.found").collect()}
    assert [(f["license"], f["confirmed"]) for f in all_known[3]] == [("ISC", True)]
    assert license_scan(docs, "text", []).select("out.n_blocks").distinct().collect()[0][0] == 0
