from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string"


@pytest.fixture
def docs_of(spark):
    """(doc_id, text) from texts, numbered from 0, or from pairs."""

    def make(*texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(pairs, DOCS)

    return make


@pytest.fixture
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with those of results."""
    long = "word " * 20_000 + "x" * 30_000
    rows = [
        (1, "A plain text of a few words, seen twice.", "en", "a", 1, 0.5, "s"),
        (1, "A plain text of a few words, seen twice.", "en", "a", 1, 0.5, "s"),
        (2, None, None, None, None, None, None),
        (None, "no id", "fr", "b", 2, 0.1, "t"),
        (3, "", "en", "a", 0, 0.2, "u"),
        (4, " \n\t ", "de", "a", 4, 0.2, "v"),
        (5, long, "en", None, 9, 0.3, "w"),
        (6, "日本語 é ß 😀 <|endoftext|> 'll", "xx", "c", 5, 0.4, "x"),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string"
    )
