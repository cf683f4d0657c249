"""Small document tables for the training-data operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of texts, with ids from 0 or given pairs, and columns whose names operators use inside."""

    def make(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(k, t, "en", "src0", None if t is None else len(t), 1, "x", 2, "y", 3) for k, t in pairs]
        return spark.createDataFrame(rows, SCHEMA + ", key int, digest string, node int, range string, fp int")

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts of several kinds: null, empty, blank, copies, near copies, accents, marks, one long text."""
    rng = random.Random(7)
    words = [a + b + c for a in ("th", "er", "on", "ré", "pf") for b in ("an", "ing", "eux", "ßo") for c in ("a", "es", "ed", "")]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = text(120)
    near = base.split()
    near[60] = "changed"
    long_text = "\n".join(text(50) for _ in range(120))
    return [
        None, "", "   \n\t ", "one", "two words", base, base, " ".join(near), text(40), text(300).upper(), "it's   what'll you'd 12345 + - £€ あい \U0001f600\n\n\n end ",
        "\x00\x01 control \x1c\x1d\x85\xa0  spaces ", "a" * 5000, long_text, "Don't  <|endoftext|> stop", "1 2 3", text(9), text(10), text(11), base,
    ]
