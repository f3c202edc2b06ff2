"""Packing against a slow best fit, its invariants, and hot sources."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.llm import packing
from marketspark.llm.shards import token_ids


def slow_best_fit(lengths, sources, clusters, capacity):
    """Bin of each piece; of equally tight bins the one changed last."""
    bins = []
    result = []
    for turn, (length, source, cluster) in enumerate(zip(lengths, sources, clusters, strict=True)):
        fits = [
            b
            for b in bins
            if b["left"] >= length and source not in b["sources"] and cluster not in b["clusters"]
        ]
        if fits:
            best = min(fits, key=lambda b: (b["left"], -b["turn"]))
        else:
            best = {"no": len(bins), "left": capacity, "sources": set(), "clusters": set()}
            bins.append(best)
        best |= {"turn": turn, "left": best["left"] - length}
        best["sources"] |= {source} - {-1}
        best["clusters"] |= {cluster} - {-1}
        result.append(best["no"])
    return result


@pytest.mark.parametrize("seed", range(5))
def test_tightest_compatible_bin(seed):
    rng = np.random.default_rng(seed)
    n = 400
    lengths = rng.integers(0, 100, n) if seed % 2 else np.sort(rng.integers(1, 100, n))[::-1]
    sources = np.where(rng.random(n) < 0.4, 0, rng.integers(-1, 70, n))
    clusters = np.where(rng.random(n) < 0.2, 3, rng.integers(-1, 150, n))
    bins, offsets = packing.best_fit(lengths, sources, clusters, 100)
    used = {}
    for i, b in enumerate(bins.tolist()):
        used.setdefault(b, []).append(i)
    for members in used.values():
        assert sum(lengths[members]) <= 100
        own = [s for s in sources[members] if s >= 0]
        copies = [c for c in clusters[members] if c >= 0]
        assert len(own) == len(set(own)) and len(copies) == len(set(copies))
        ends = 0
        for i in members:
            assert offsets[i] == ends
            ends += lengths[i]
    assert bins.tolist() == slow_best_fit(lengths.tolist(), sources.tolist(), clusters.tolist(), 100)


def test_first_tightest_bin_is_taken_not_the_first_one():
    lengths = np.array([60, 80, 15, 15, 15])
    none = np.full(5, -1)
    bins, offsets = packing.best_fit(lengths, none, none, 100)
    assert bins.tolist() == [0, 1, 1, 0, 0] and offsets.tolist() == [0, 0, 80, 60, 75]
    bins, _ = packing.best_fit(lengths, np.array([1, 2, 2, 2, 1]), none, 100)
    assert bins.tolist() == [0, 1, 0, 2, 1]  # past the tightest, which holds the source
    bins, _ = packing.best_fit(lengths, none, np.array([0, 1, 1, 0, 5]), 100)
    assert bins.tolist() == [0, 1, 0, 1, 0]


def test_more_than_64_sources_and_clusters():
    n = 500
    bins, _ = packing.best_fit(np.ones(n, int), np.arange(n), np.full(n, -1), 1000)
    assert set(bins.tolist()) == {0}
    bins, _ = packing.best_fit(np.ones(n, int), np.arange(n) % 100, np.full(n, -1), 1000)
    assert sorted(np.bincount(bins).tolist()) == [100] * 5
    bins, _ = packing.best_fit(np.ones(n, int), np.full(n, -1), np.arange(n) // 2, 1000)
    assert sorted(np.bincount(bins).tolist()) == [250] * 2


def test_numbers():
    assert packing.numbered(pd.Series(["a", None, "b", "a"])).tolist() == [0, -1, 1, 0]
    assert packing.numbered(pd.Series([5, None, 6, 5]), only_shared=True).tolist() == [0, -1, -1, 0]
    assert packing.numbered(pd.Series([], dtype=object), only_shared=True).tolist() == []


def test_pieces_cover_every_row(spark):
    random.seed(2)
    texts = [(i, "x" * random.choice([0, 5, 90, 100, 101, 250, 1000]), "hot" if i % 3 else f"s{i}") for i in range(300)]
    texts += [(300, None, None), (300, None, None), (None, "abc", "hot"), (301, "Same Text", "a"), (302, "same  text", "b")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, source string")
    bytes_ = F.octet_length("text")
    rows = packing.pack_texts(df, capacity=100, length=bytes_, group_pieces=150).collect()
    source = {i: s for i, _, s in texts}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["bin"], []).append(r)
    for i, text, _ in texts:
        if i != 300:
            pieces = sorted(by_doc[i], key=lambda r: r["piece"])
            assert sum(p["length"] for p in pieces) == len(text)
            assert [p["start"] for p in pieces] == [k * 100 for k in range(len(pieces))]
            assert all(p["pieces"] == len(pieces) for p in pieces)
    assert len(by_doc[300]) == 2
    for members in by_bin.values():
        assert sum(r["length"] for r in members) <= 100
        own = [source[r["doc_id"]] for r in members if source[r["doc_id"]] is not None]
        assert len(own) == len(set(own))
        assert not {301, 302} <= {r["doc_id"] for r in members}
    assert len({b >> 32 for b in by_bin}) > 1


def test_awkward_rows(awkward):
    rows = packing.pack_texts(awkward).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, None, 3, 4, 5, 6}
    tokens = [len(token_ids(r["text"] or "")) for r in awkward.collect()]
    assert sum(r["length"] for r in rows) == sum(tokens) and max(r["pieces"] for r in rows) > 10
    assert sorted(r["length"] for r in rows if r["doc_id"] in (2, 3)) == [1, 1]
    in_bytes = packing.pack_texts(awkward, length=F.octet_length("text")).collect()
    assert sum(r["length"] for r in in_bytes) == awkward.agg(F.sum(F.octet_length("text"))).first()[0]
    assert packing.pack_texts(awkward.limit(0)).count() == 0
