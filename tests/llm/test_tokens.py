"""Token counts against the library, at every prefix."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketspark.llm import tokens

LIBRARY = Tokenizer.from_file(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def counter():
    return tokens.PrefixCounter()


def counted(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefghijklmnop \n\t'réß日😀.,<|endoftext|>0159"), max_size=30))
def test_every_prefix(text):
    counter = tokens.counter_for(tokens.VOCABULARY)
    assert counter.counts(text).tolist() == [counted(text[: i + 1]) for i in range(len(text))]


@pytest.mark.parametrize(
    "text",
    [
        "we're  they've  it's   x'll'",
        "a<|endoftext|>'re  b<|endoftext|><|endoftext|>",
        "<|endoftext|",
        " " * 40 + "x" + "\n" * 9 + "y  ",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 5,
        "ÀÉ漢字かな交じり文 ﷽    end",
    ],
)
def test_awkward_prefixes(counter, text):
    assert counter.counts(text).tolist() == [counted(text[: i + 1]) for i in range(len(text))]


def test_long_pieces_and_a_small_memory(counter, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 3)
    random.seed(3)
    text = "".join(random.choice("abcde") for _ in range(20_000)) + " end of it"
    assert counter.total(text) == counted(text)
    assert len(counter.known) <= 3


def test_counts_of_a_table(spark, awkward):
    rows = tokens.count_tokens(awkward, limit=20).collect()
    texts = [r["text"] or "" for r in awkward.collect()]
    found = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)
    assert found == sorted((len(t.encode()), counted(t), counted(t) > 20) for t in texts)
    assert [r["doc_id"] for r in rows].count(1) == 2 and [r["doc_id"] for r in rows].count(None) == 1
    assert tokens.count_tokens(awkward.limit(0)).count() == 0


def test_budgets_are_read_off_the_table(docs_of):
    text = "The quick brown fox, isn't  it? <|endoftext|> 12345 end"
    table = tokens.prefix_table(docs_of(text, "", None))
    columns = [tokens.chars_within(n).alias(f"c{n}") for n in (0, 1, 7, 99)]
    first = table.orderBy("doc_id").select(*columns, tokens.tokens_of_prefix(9).alias("t"), F.size("prefix_tokens"))
    rows = first.collect()
    longest = lambda n: max((i for i in range(len(text) + 1) if counted(text[:i]) <= n), default=0)
    assert list(rows[0])[:4] == [longest(n) for n in (0, 1, 7, 99)]
    assert rows[0]["t"] == counted(text[:9]) and rows[1]["t"] == 0 and list(rows[2])[:4] == [0] * 4
    short = tokens.count_tokens(docs_of(text), limit=7).first()
    assert short["fitting_chars"] == longest(7)
