"""Training order: a permutation, an exact round trip, and resumable reads."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from marketspark.llm import shards
from marketspark.llm.common import folder


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    found = shards.permuted(np.arange(n), n)
    assert sorted(found.tolist()) == list(range(n))
    if n > 100:
        assert abs(np.corrcoef(np.arange(n), found)[0, 1]) < 0.1
        assert (found != shards.permuted(np.arange(n), n, key=99)).mean() > 0.9


def test_round_trip(spark, awkward):
    path = folder(spark, "test-shards")
    total = shards.write_shards(awkward.repartition(3).cache(), path, tokens=64, shard_rows=100)
    rows = shards.read_shards(spark, path, tokens=64, shard_rows=100).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(total))
    stride = shards.stride_of(64)
    assert all(r["shard"] == r["slot"] // 100 and r["at"] == r["slot"] % 100 * stride for r in rows)
    texts = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        assert len(r["tokens"]) == 2 * r["n_tokens"] <= 128
        if r["doc_id"] not in (1,):
            texts[r["doc_id"]] = texts.get(r["doc_id"], b"") + bytes(r["tokens"])
    for doc in awkward.collect():
        ids = shards.token_ids(doc["text"] or "")
        if doc["doc_id"] != 1:
            assert np.frombuffer(texts[doc["doc_id"]], "<u2").tolist() == ids.tolist()
            assert shards.encoder().decode(ids[:-1].tolist()) == (doc["text"] or "")
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    later = shards.read_shards(spark, path, tokens=64, shard_rows=100, first_slot=150).orderBy("slot").collect()
    assert later == rows[150:]


def test_every_byte_survives(spark, docs_of):
    """Token numbers that are line feeds, zeros and bytes that are no UTF-8 are written as they are."""
    text = "".join(chr(c) for c in range(1, 1500)) + " ".join(str(i) for i in range(3000))
    path = folder(spark, "test-shards")
    shards.write_shards(docs_of(text), path)
    rows = shards.read_shards(spark, path).orderBy("place").collect()
    got = np.frombuffer(b"".join(bytes(r["tokens"]) for r in rows), "<u2")
    assert got.tolist() == shards.token_ids(text).tolist()
    assert len({b for r in rows for b in bytes(r["tokens"])}) > 200


def test_query_form(spark, docs_of):
    rows = shards.training_order(docs_of("a b c", None, "d")).collect()
    assert sorted((r["doc_id"], r["place"]) for r in rows) == [(0, 0), (1, 0), (2, 0)]
    crc = {r["doc_id"]: r["crc"] for r in rows}
    assert crc[1] == shards.crc_of(np.array([shards.END]))
    assert shards.training_order(docs_of("x").limit(0)).count() == 0


def test_tokens_equal_the_library():
    """Texts cut before the last white space of a run have the tokens of the whole text, whatever stands there."""
    assert "(?!" not in shards.PLAIN  # what makes the library's pattern slow
    whole = shards.encoder().encode_ordinary
    signs = [" ", "\n", "\t", "\xa0", "\u2003", "\x1c", "\x85", "\u200b", "a", "'s", "9", "."]
    texts = ["".join(x) for n in range(6) for x in product([" ", "\n", "\x1c", "a", "'s"], repeat=n)]
    texts += ["".join(x) for n in (3, 4) for x in product(signs, repeat=n)]
    texts += ["it's  we'll\n   go \n\n on ", "x" * 500 + " \ud800 y", "日本語 é ß 😀 <|endoftext|> 'll"]
    texts += [f"{a}{chr(c)}{chr(c)}{b}" for c in range(0x3100) for a, b in (("a", "b"), (" ", " b"))]
    for text in texts:
        assert shards.encoded(text) == whole(text), repr(text)
