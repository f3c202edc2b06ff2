"""Quality rules against a slow version of each count and distance."""

from __future__ import annotations

import math
import re
import time

import pytest

from marketspark.llm import rules


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    "",
    None,
    "one two",
    "a b c d e a b c d e a b c d e f g h i j k",
    "a a a a a a a a a a a a",
    "line one here\nline one here\n \nline one here\n\nother line with words enough to pass it",
    "ÀÉ ßß 😀😀 漢字 x\x0by\x0cz # * $ % & | < > && tail of some words more words",
    "p q r s t u v w x y p q r s t z",
    "no windows twice at all in this text of many different words, is there any?",
]


def test_base_counts(docs_of):
    docs = docs_of(*TEXTS).selectExpr("*", "'en' AS lang")
    rows = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        wanted = slow_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == wanted, text
        assert r["base_failed"] == (wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0])
        assert not (r["kept"] and r["base_failed"])


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    parts = [
        (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
        for a, b in zip(p, q, strict=True)
    ]
    return math.sqrt(max(sum(parts) / 2, 0))


def test_distances_and_verdicts(spark):
    import random

    random.seed(4)
    common, letters = rules.COMMON["en"], "abcdefghijklmnopqrstuvwxyz"

    def prose(n):
        return " ".join(random.choice(common) if random.random() < 0.5 else f"word{random.choice(letters)}{random.choice(letters)}" for _ in range(n))

    good = [prose(150) for _ in range(300)]
    signs = " ".join(f"%%#{i}&&*$|" for i in range(200))
    foreign = " ".join(f"zq{chr(97 + i % 26)}{chr(97 + i // 26)}kkk" for i in range(300))
    short = "%% ## && ** $$ || << >> %#% #&# *$*"
    docs = [(1000 + i, t, "en") for i, t in enumerate(good)] + [
        (100, signs, "en"),
        (101, foreign, "en"),
        (102, short, "en"),
        (103, signs, "xx"),
        (104, signs, None),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    rows = {r["doc_id"]: r for r in rules.quality_rules(df).collect()}
    assert all(rows[1000 + i]["kept"] for i in range(300))
    assert not rows[100]["kept"] and rows[100]["char_distance"] > rules.MAX_CHAR_DISTANCE
    assert rows[101]["word_distance"] > 0.5, rows[101]
    assert not rows[101]["kept"] and rows[101]["word_distance"] > rules.MAX_WORD_DISTANCE
    assert rows[102]["kept"] and rows[102]["char_distance"] is None  # too short to tell
    assert rows[103]["kept"] and rows[104]["kept"]  # no reference
    measured = {r["doc_id"]: r for r in rules.measured(df).collect()}
    passed = [r for r in measured.values() if not r["base_failed"] and r["lang"] == "en"]
    for bins, name in (("chars", "char_distance"), ("common", "word_distance")):
        total = [sum(x) for x in zip(*(r[bins] for r in passed), strict=True)]
        assert rows[100][name] == pytest.approx(distance(measured[100][bins], total), abs=1e-9)


def test_histogram_bins(docs_of):
    text = "The cat OF 3 dogs, and: (the) end_ the"
    row = rules.measured(docs_of(text).selectExpr("*", "'en' AS lang")).first()
    plain = "".join(text.split())
    assert row["chars"] == [3, 1, 0, 2, 3, len(plain) - 9]
    assert row["common"][:3] == [2, 1, 0] and sum(row["common"]) == len(text.split())


def test_awkward_rows_and_no_python(awkward):
    found = rules.quality_rules(awkward)
    assert sorted(str(r["doc_id"]) for r in found.collect()) == ["1", "1", "2", "3", "4", "5", "6", "None"]
    assert rules.quality_rules(awkward.limit(0)).count() == 0
    plan = rules.measured(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_text_of_repeats(docs_of):
    """Time in proportion to the words: places of repeats are not gathered one by one into growing arrays."""
    words = [f"w{i}" for i in range(60_000)]
    text = " ".join(words + words)
    began = time.monotonic()
    row = rules.measured(docs_of(text).selectExpr("*", "'en' AS lang")).first()
    assert time.monotonic() - began < 15
    assert (row["n_words"], row["n_repeat_words"], row["base_failed"]) == (120_000, 120_000, True)


def test_common_words_of_other_lists(docs_of):
    """A word counts by its own language's list only, whatever its case; without a list there is none."""
    text = "la LA de que der THE the_ und"
    for lang, counts in (("fr", {1: 2, 2: 1, 8: 1}), ("de", {0: 1, 2: 1}), ("en", {0: 1}), ("xx", {})):
        row = rules.measured(docs_of(text).selectExpr("*", f"'{lang}' AS lang")).first()
        assert row["common"] == [counts.get(i, 0) for i in range(12)] + [8 - sum(counts.values())], lang
