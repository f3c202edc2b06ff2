"""The chain field: marginals against enumeration, learning, held-out accuracy, spans."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from marketspark.llm import toxicity

BAD = ["grotto", "blarg", "snirkel"]
STEM = "vexu"


def prose(rng, n):
    return ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def toxic_text(rng, n):
    words = prose(rng, n)
    for _ in range(rng.randint(2, 5)):
        bad = rng.choice(BAD) if rng.random() < 0.5 else STEM + "".join(rng.choice("aeiost") for _ in range(4))
        words.insert(rng.randrange(len(words)), bad)
    return " ".join(words)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(12)
    return [(i, toxic_text(rng, 60) if i % 4 == 0 else " ".join(prose(rng, 60)), int(i % 4 == 0)) for i in range(700)]


@pytest.fixture(scope="module")
def tables(spark, made):
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in made], "doc_id bigint, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("seed", range(4))
def test_marginals_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    lengths = [1, 4, 7, 2]
    scores = rng.normal(0, 2, sum(lengths))
    step, first = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    firsts = np.zeros(len(scores), bool)
    firsts[np.cumsum([0, *lengths[:-1]])] = True
    found = toxicity.chain_marginals(scores, firsts, step, first)[0]
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        total, marked = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            value = first[tags[0]] + sum(step[a, b] for a, b in itertools.pairwise(tags))
            weight = np.exp(value + sum(s for s, t in zip(own, tags, strict=True) if t))
            total += weight
            marked += weight * np.array(tags)
        assert np.allclose(found[at : at + n], marked / total, atol=1e-9)
        at += n


def test_long_chains_in_columns(monkeypatch):
    rng = np.random.default_rng(1)
    scores, firsts = rng.normal(0, 3, 1000), rng.random(1000) < 0.01
    firsts[0] = True
    step, first = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    whole = toxicity.chain_marginals(scores, firsts, step, first)[0]
    monkeypatch.setattr(toxicity, "COLUMN", 7)
    assert np.allclose(whole, toxicity.chain_marginals(scores, firsts, step, first)[0], atol=1e-9)


def test_held_out_accuracy_and_spans(tables, made):
    rows = {r["doc_id"]: r for r in toxicity.toxicity(*tables).collect()}
    assert len(rows) == len(made)
    wrong = 0
    for i, text, y in made:
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"]:
            wrong += r["predicted"] != y
            if y and r["predicted"]:
                marked = " ".join(text[s["start_at"] : s["end_at"]] for s in r["spans"]).split()
                assert any(w in BAD or w.startswith(STEM) for w in marked), marked
    assert wrong <= 4


def test_nothing_is_learned_from_held_out_labels(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    rest = toxicity.remainder(F.col("doc_id"), 3) == 1
    spoilt = labels.withColumn("toxic", F.when(rest, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert one == {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spoilt).collect()}


def test_telling_features_explain_all(made):
    texts, toxic = [t for _, t, _ in made], np.array([y == 1 for _, _, y in made])
    held = [{f for w in set(toxicity.words_of(t)) for f in toxicity.features(w) if f[0] != "e"} for t in texts]
    chosen = toxicity.telling_features(held, toxic)
    left = [h for h, t in zip(held, toxic, strict=True) if t and not any(f in chosen for f in h)]
    assert len(left) < toxicity.LEAST_SUPPORT
    assert any(STEM.startswith(f[1:4]) for f in chosen if f[0] == "b")


def test_copies_do_not_count_twice():
    rng = random.Random(3)
    one, two = " ".join(prose(rng, 80)), " ".join(prose(rng, 80))
    texts, toxic = toxicity.without_copies([one, one + " x", two, one], np.array([True, True, False, True]))
    assert texts == [one, two] and toxic.tolist() == [True, False]


def test_span_places():
    text = "İz 12 Blarg, grotto! ok"
    chance = np.array([0.0, 0.9, 0.8, 0.1])
    assert [text[a:b] for a, b, _ in toxicity.toxic_spans(text, chance)] == ["Blarg, grotto"]
    assert toxicity.document_score(np.array([])) == 0 and toxicity.document_score(np.array([0.5, 0.5])) == 0.75


def test_awkward_rows(spark, awkward, tables):
    rows = toxicity.toxicity(awkward, tables[1]).collect()
    assert len(rows) == 8 and {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0.0}
    nothing = toxicity.toxicity(awkward, tables[1].limit(0)).collect()
    assert max(r["score"] for r in nothing) < 1e-6
    odd = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(awkward, odd).count() == 8
    assert toxicity.toxicity(awkward.limit(0), tables[1]).count() == 0
