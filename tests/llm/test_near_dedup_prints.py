"""The near-copy stage of the pipeline takes proposals from the fingerprint operator as well."""

from __future__ import annotations

import corpus_pipeline
from marketspark.llm import copies, simhash
from marketspark.llm.common import Scratch
from tests.llm.test_copies import slow_roots

WORDS = [f"word{i}" for i in range(120)]
TEXTS = [
    " ".join(WORDS),
    " ".join(WORDS[:-1]),
    " ".join(WORDS).upper(),
    " ".join(reversed(WORDS)),
    "",
    " \n",
    "a short one",
]


def test_linked_fingerprints_share_a_key(docs_of, spark):
    """Sets meet under a key exactly if the operator links a text of one with a text of the other."""
    docs = docs_of(*TEXTS)
    marked = copies.signed(docs, "_sign")
    rows = marked.selectExpr("_sign.fp", "_sign.size", "text")
    scratch = Scratch(spark)
    keys = {(r["key"], r["node"]) for r in copies.print_keys(scratch, rows).collect()}
    fp_of = {r["doc_id"]: r["fp"] for r in marked.selectExpr("doc_id", "_sign.fp").collect()}
    part = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    blank = fp_of[4]
    assert blank == fp_of[5] and blank not in {node for _, node in keys}
    for i in (0, 1, 2, 3, 6):
        for j in (0, 1, 2, 3, 6):
            met = any((key, fp_of[j]) in keys for key, node in keys if node == fp_of[i])
            assert met == (part[i] == part[j] or fp_of[i] == fp_of[j]), (i, j)
    scratch.drop()


def test_stage_asks_the_operator(docs_of, spark, monkeypatch):
    asked = []
    real = simhash.grouped
    monkeypatch.setattr(copies, "grouped", lambda rows, *a: asked.append(rows.count()) or real(rows, *a))
    kept = corpus_pipeline.one_of_each(spark, docs_of(*TEXTS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(slow_roots(TEXTS)))
    assert asked and asked[0] >= 3
