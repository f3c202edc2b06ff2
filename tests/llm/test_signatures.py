"""Shingle hashes of many texts at once, against sets of words, and what signatures cost."""

from __future__ import annotations

import random
import sys
import time

import numpy as np
import pandas as pd
import pytest

from marketspark.llm import copies
from marketspark.llm.common import read

SF_DIR = "/root/testdata/sf0.01"
ODD = ["", " \n", "a", "A", "a b", "a\x1cb", "b a", "ab", "a a a a a a a", "\x00", "\x00\x00", "Two words", "two　 WORDS"]
ODD += ["ΑΣ ΟΔΟΣ", "İ x\x85y z q w", "\ud800 a", "z" * 5000, "z" * 4999 + "y", " " * 3000 + "q", "ἀ β γ δ ε ζ", "𝒳 😀 😀 😀 😀 😀"]


def slow_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


@pytest.mark.parametrize("chars", [1, 60, 1 << 15])
def test_hashes_stand_for_shingles(monkeypatch, chars):
    """One hash for each shingle, and the same one in every text, however texts are dealt into portions."""
    monkeypatch.setattr(copies, "CHARS_AT_ONCE", chars)
    rng = random.Random(9)
    white = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    words = ["a", "b", "ab", "ba", "Ab", "aba", "é", "日本", "w" * 300]
    texts = [*ODD, None]
    for _ in range(300):
        texts.append("".join(rng.choice(words) + rng.choice(white) * rng.randint(1, 2) for _ in range(rng.randrange(25))))
    rng.shuffle(texts)
    found = [parts.tolist() for parts in copies.shingle_sets(texts)]
    expected = [slow_set(t) for t in texts]
    assert [len(f) for f in found] == [len(e) for e in expected]
    assert all(f == sorted(set(f)) for f in found)
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(found[i]) & set(found[j])) == len(expected[i] & expected[j]), (texts[i], texts[j])


def test_white_space_is_that_of_split():
    assert copies.WHITE.tolist() == [chr(i).isspace() for i in range(sys.maxunicode + 1)]


def test_signatures_of_a_slice_are_those_of_single_texts():
    sign = copies._signatures()
    texts = [*ODD, "one two three four five six", "one two  three four FIVE six"]
    together = sign(texts).to_pylist()
    assert together == [row for t in texts for row in sign([t]).to_pylist()]
    assert together[-1] == together[-2] and len(together[-1]["bands"]) == copies.BANDS
    assert together[0]["size"] == 0 and together[0]["bands"] == [] and sign([]).to_pylist() == []


def test_shares_of_equal_hashes_follow_similarity():
    """Equal minimum hashes estimate the similarity, and bands are equal where their four hashes are."""
    rng = np.random.default_rng(10)
    for share in (0.5, 0.8, 0.95):
        equal, bands = [], 0
        for _ in range(60):
            both = round(400 * share)
            some = rng.integers(0, 1 << 64, 800 - both, np.uint64)
            a, b = copies.minima(np.sort(some[:400])), copies.minima(np.sort(some[400 - both :]))
            equal.append((a == b).mean())
            same = (a == b).reshape(copies.BANDS, copies.BAND_HASHES).all(axis=1)
            assert ((copies.bands_of(a) == copies.bands_of(b)) == same).all()
            bands += same.any()
        assert abs(np.mean(equal) - both / (800 - both)) < 0.04
        assert share < 0.9 or bands == 60


def test_words_cost_less_than_strings_hashed_one_by_one(spark):
    """As words were hashed before, when signatures were the larger part of op8's CPU time."""
    texts = [r["text"] or "" for r in read(spark, SF_DIR, "documents").collect()]

    def one_by_one():
        for text in texts:
            pd.util.hash_array(np.array(text.lower().split(), object), categorize=False)

    def together():
        for some in copies.portions([text.lower() for text in texts]):
            copies.word_hashes(some)

    def seconds(work):
        taken = []
        for _ in range(5):
            begin = time.process_time()
            work()
            taken.append(time.process_time() - begin)
        return min(taken)

    assert seconds(together) < 0.75 * seconds(one_by_one)
