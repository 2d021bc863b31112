"""Merge replay against tiktoken and the round trip."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from splitlane.llm import byte_pairs
from splitlane.llm import words as W
from splitlane.llm.byte_pairs import Splitter, decoded, encoded, lexicon, points_of, replay, split_words, vocabulary
from splitlane.llm.queries import QUERIES

PATTERN = public_tokenizers.PATTERN
RANKS = public_tokenizers.path(byte_pairs.RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary(RANKS).ids, special_tokens={})


def split(*texts):
    raw, offsets = W.utf8(pa.array(texts))
    found = split_words(raw, offsets, Splitter(PATTERN))
    return [raw[a:b].tobytes().decode() for a, b in zip(found.start, found.end, strict=True)]


def ids(value):
    return np.frombuffer(value, "<u4").tolist()


def test_words_replayed_together_equal_the_library(library):
    rng = random.Random(3)
    tokens = list(vocabulary(RANKS).ids)
    joined = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 8))).decode("utf8", "ignore") for _ in range(4000)]
    words = sorted(set(split(*joined)))
    words += ["", "a" * 3000, "ab" * 2000, "漢字" * 50, *("".join(rng.choice("aeinrst") for _ in range(30)) for _ in range(500))]
    got = replay([w.encode() for w in words], vocabulary(RANKS))
    assert [ids(v) for v in got] == [library._encode_single_piece(w) if w else [] for w in words]


@pytest.mark.parametrize("at_once", [False, True])
def test_a_merge_that_opens_a_lower_rank_lets_it_go_first(monkeypatch, at_once):
    vocab = object.__new__(byte_pairs.Vocabulary)
    table = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 256, b"cab": 257}
    vocab.ids, vocab.width, vocab.of_byte = table, 301, np.arange(256)
    known = tiktoken.Encoding("t", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={})
    rng = random.Random(1)
    if at_once:
        monkeypatch.setattr(byte_pairs, "AT_ONCE", 1)
    words = ["abcab", "ababcabcab", *("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(300))]
    got = replay([w.encode() for w in words], vocab)
    assert [ids(v) for v in got] == [known.encode_ordinary(w) for w in words]


def test_texts_are_split_as_the_library_splits_them():
    single = {bytes([b]): b for b in range(256)}
    points = [chr(c) for c in [*range(0x3500), *range(0xA000, 0xAC00), *range(0x10000, 0x20000, 3), 0x20001, 0x3D001]]
    for first in "a1!\n":
        ranks = dict(single)
        for c in points:
            ranks.setdefault((first + c).encode(), len(ranks))
        whole = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        raw, offsets = W.utf8(pa.array([first + c for c in points]))
        found, at, _ = points_of(raw, offsets)
        starts = Splitter(PATTERN).starts(found, at)
        assert [len(whole.encode_ordinary(first + c)) > 1 for c in points] == starts[at[:-1] + 1].tolist()


def test_texts_of_all_kinds_are_split_by_the_pattern(monkeypatch):
    rng = random.Random(2)
    pattern = regex.compile(PATTERN)
    texts = ["".join(rng.choice("ab1!'stremvld  \n\t\u00a0\x1cé½") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert split(*texts) == [w for t in texts for w in pattern.findall(t)]
    monkeypatch.setattr(byte_pairs, "CHUNK", 7)
    monkeypatch.setattr(W, "BLOCK_BYTES", 20)
    cut = Splitter(PATTERN)
    got = []
    for raw, offsets in byte_pairs.parts(pa.array(texts)):
        found = split_words(raw, offsets, cut)
        got += [raw[a:b].tobytes().decode() for a, b in zip(found.start, found.end, strict=True)]
    assert got == [w for t in texts for w in pattern.findall(t)]


def test_odd_rows_equal_the_library_with_and_without_a_lexicon(spark, odd_docs, no_docs, library):
    docs = odd_docs.repartition(3)
    table = lexicon(docs, PATTERN, RANKS)
    assert table.num_rows > 50
    for shared in (None, table):
        rows = encoded(docs, PATTERN, RANKS, shared=shared, back=True).select("row.*", "out.*").collect()
        assert len(rows) == odd_docs.count()
        for row in rows:
            assert ids(row.ids) == library.encode_ordinary(row.text or "")
            assert bytes(row.bytes) == (row.text or "").encode()
    back = decoded(encoded(docs, PATTERN, RANKS).select("out.ids", "row.text"), RANKS)
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back.select("row.text", "out.bytes").collect())
    assert decoded(spark.createDataFrame([(None,)], "ids binary"), RANKS).select("out.bytes").collect()[0][0] is None
    assert encoded(no_docs, PATTERN, RANKS, shared=lexicon(no_docs, PATTERN, RANKS)).count() == 0


def test_the_lexicon_holds_the_most_frequent_shared_words_within_its_bound(spark):
    docs = spark.createDataFrame([(i, "the the the a of " + f"only{i} " + "w" * 80) for i in range(8)], "doc_id long, text string")
    docs = docs.repartition(4, "doc_id")
    whole = {r["word"].decode() for r in lexicon(docs, PATTERN, RANKS).to_pylist()}
    assert {"the", " the", " a", " of"} <= whole and not any("only" in w and len(w) > 5 for w in whole)
    assert all(len(w) <= 32 for w in whole)
    assert [r["word"] for r in lexicon(docs, PATTERN, RANKS, most=1).to_pylist()] == [b" the"]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_the_library(spark, library, sf):
    found = {r.doc_id: r for r in QUERIES["op11_corpus_merge_replay"].run(spark, f"/root/testdata/{sf}").collect()}
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        wanted = library.encode_ordinary(d.text or "")
        row = found[d.doc_id]
        assert row.n_tokens == len(wanted)
        assert row.ids_sha256 == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_memory_of_a_slice_is_that_of_its_texts():
    texts = pa.array(["x" * 10, None, "y" * 100, ""])
    assert list(W.blocks(W.sizes(texts), 50)) == [(0, 2), (2, 3), (3, 4)]
