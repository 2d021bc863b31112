"""What a worker holds at once, whatever the texts are like."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest

from splitlane.llm import pii
from splitlane.llm import words as W
from splitlane.llm.pii_base import base_spans


@pytest.fixture(scope="module")
def field():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abdeilnorst") for _ in range(6))
    texts = [f"{word()} {word()} mail {word()}@{word()}.example.org or +1 (555) 010-{i:04d} {word()}" for i in range(40)]
    return pii.train([(t, base_spans(t)) for t in texts], steps=20)


@pytest.mark.parametrize(
    ("text", "most_mb"),
    [("a\n" * 1_000_000, 120), ("some 12 words of a line x@y.example.org\n" * 50_000, 200), ("plain words in lines\n" * 800_000, 400)],
)
def test_the_field_sees_a_long_text_in_pieces(field, text, most_mb):
    work = pii.finder(field, True)()
    batch = pa.array([text])
    tracemalloc.start()
    work(batch)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < most_mb


def test_pieces_give_the_same_runs_as_whole_blocks(field, monkeypatch):
    rng = random.Random(3)
    kinds = ["\n", " ", "word ", "tel 555 010 9999 ", "a@b.example.org ", "+1 (555) 010-9999\n", "é "]
    texts = ["".join(rng.choice(kinds) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    raw, offsets = W.utf8(pa.array([*texts, "", None, texts[0]]))
    whole = pii.labelled_runs(raw, W.split(raw, offsets, W.NOT_SPACE), field)
    for size in (1, 50, 1000):
        monkeypatch.setattr(pii, "PIECE_BYTES", size)
        got = list(pii.runs_by_piece(raw, offsets, field))
        assert [r[:5] for r in got] == [r[:5] for r in whole] and len(whole) > 100
