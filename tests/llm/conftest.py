from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, white, short and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(200)
    near = base.split(" ")
    near[50] = "changed"
    texts = [
        None, "", "  \n\t ", "one", "one two", base, base, " ".join(near), base.upper(), prose(30_000),
        "x@y.example.org and 10.0.0.1 or 4111 1111 1111 1111, +1 (555) 010-9999 ünïcode é",
        prose(40) + "\nReleased under the MIT License.\n" + prose(30), "ab cd ef gh ij " * 30, "<|endoftext|> a  b",
    ]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id here at all", None, None, None, None, None), (99, texts[10], None, "s", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
