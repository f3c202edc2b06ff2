"""The neighbour classifier: products against brute force, held-out accuracy, odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.llm import quality


def prose(rng, n):
    words = ["the", "cat", "Old", "house,", "runs", "by", "a", "river.", "people", "often", "see", "it"]
    return " ".join(rng.choice(words) for _ in range(n))


def junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choice(["foo%%%", "bar###", "x$$$", "###"]) for _ in range(n))
    if kind == 1:
        return " | ".join(rng.choice(["aa", "bb", "17"]) for _ in range(n))
    return " ".join(w for _ in range(n // 10 + 1) for w in [rng.choice(["der", "und", "das"])] * 10)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    docs = [(i, junk(rng, rng.randint(15, 90)) if i % 5 == 0 else prose(rng, rng.randint(15, 90))) for i in range(600)]
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(600)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, made):
    docs, labels = made
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_held_out_accuracy(tables):
    rows = quality.classify(*tables).collect()
    assert len(rows) == 600
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    right = [r["predicted"] == (r["doc_id"] % 5 > 0) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.97


def test_nothing_is_learned_from_held_out_labels(spark, tables):
    docs, labels = tables
    rest = quality.remainder(F.col("doc_id"), 4) == 2
    spoilt = labels.withColumn("quality", F.when(rest, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    two = {r["doc_id"]: r["score"] for r in quality.classify(docs, spoilt).collect()}
    assert one == two


def test_blocks_of_exact_products(made):
    docs, labels = made
    terms = quality.Terms()
    counts = np.array([terms.counts(t) for _, t in docs], np.float32)
    known = np.array([q for _, q, _ in labels], float)
    model = quality.fit(counts[:400], known[:400])
    vectors = model.project(counts)
    scores = model.scores(counts[400:450])
    for i, score in zip(range(400, 450), scores, strict=True):
        cosines = sorted(((float(vectors[i] @ v), known[j]) for j, v in enumerate(model.vectors)), reverse=True)
        near = cosines[: quality.NEIGHBOURS]
        weights = [max(c, 0) / (1.01 - min(c, 1)) for c, _ in near]
        wanted = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights)
        if cosines[quality.NEIGHBOURS - 1][0] - cosines[quality.NEIGHBOURS][0] > 1e-5:  # no tie at the edge
            assert score == pytest.approx(wanted, abs=1e-3)


def test_main_directions():
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((80, 5)) * [9, 7, 5, 3, 2]) @ rng.standard_normal((5, 60))
    found = quality.main_directions(rows.astype(np.float32), 5)
    _, _, exact = np.linalg.svd(rows, full_matrices=False)
    assert np.allclose(np.abs(np.linalg.svd(found.T @ exact[:5].T)[1]), 1, atol=1e-3)


def test_shapes():
    assert quality.shape_of("Thing,") == "Aa," and quality.shape_of("osll***") == "a*"
    assert quality.shape_of("2024-11") == "0-0" and quality.shape_of("ÉTÉ!!") == "A!"
    assert quality.Terms().counts("").sum() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(quality, "KNOWN_WORDS", 5)
    terms = quality.Terms()
    whole = quality.Terms().counts(" ".join(f"w{i}" for i in range(100)))
    assert (terms.counts(" ".join(f"w{i}" for i in range(100))) == whole).all() and len(terms.known) <= 5


def test_awkward_rows(spark, awkward, tables):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (1, 0, 0), (None, 1, 0), (6, None, 0), (5, 0, 0), (77, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    rows = quality.classify(awkward, labels).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    none = quality.classify(awkward, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {0}
    assert quality.classify(awkward.limit(0), tables[1]).count() == 0
    kept = quality.keep_good(awkward, tables[1])
    assert kept.columns == awkward.columns


def test_keeping(tables, made):
    kept = {r["doc_id"] for r in quality.keep_good(*tables).collect()}
    wanted = {r["doc_id"] for r in quality.classify(*tables).collect() if r["predicted"] == 1}
    assert kept == wanted
