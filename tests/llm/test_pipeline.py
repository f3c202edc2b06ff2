"""The pipeline stage by stage against slow versions, and its place in the entry module."""

from __future__ import annotations

import importlib
import re
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from marketspark.llm import decontaminate, quality, secrets
from marketspark.llm.common import read, stored
from marketspark.llm.queries import ORACLES, QUERIES
from marketspark.llm.shards import token_ids
from tests.llm.test_copies import slow_roots

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, made = read(spark, SF_DIR, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = (docs, stored(stage(spark, docs, SF_DIR), f"test-{name}"))
        docs = made[name][1]
    return made


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_and_columns(outputs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "secrets", "packing"]
    for name in names[:-1]:
        before, after = outputs[name]
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, outputs):
    before, after = outputs["quality"]
    judged = quality.classify(before, read(spark, SF_DIR, "labels"))
    assert ids(after) == ids(judged.where("predicted = 1"))


def test_near_dedup_stage(outputs):
    """One row of each group of texts that share 0.8 of their five-word shingles, by all pairs."""
    before, after = outputs["near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert ids(after) == sorted({rows[i][0] for i in slow_roots([t for _, t in rows])})


def test_decontamination_stage(spark, outputs):
    before, after = outputs["decontamination"]
    fold = lambda t: "".join(map(chr, decontaminate.folded(t)[0])).strip()
    items = [fold(r["text"]) for r in read(spark, SF_DIR, "benchmark").collect()]
    whole = {r["doc_id"] for r in before.collect() if any(i in fold(r["text"]) for i in items)}
    kept = set(ids(after))
    assert whole and not whole & kept
    index = decontaminate.Index(
        [decontaminate.make_item(r["item_id"], r["text"]) for r in read(spark, SF_DIR, "benchmark").collect()]
    )
    assert kept == {r["doc_id"] for r in before.collect() if not decontaminate.leaks(index, r["text"])}


def test_secrets_stage(outputs):
    before, after = outputs["secrets"]
    old = {r["doc_id"]: r for r in before.collect()}
    scanner, changed = secrets.Scanner(), 0
    for r in after.collect():
        spans = scanner.spans(old[r["doc_id"]]["text"])[1]
        assert r["text"] == secrets.redacted(old[r["doc_id"]]["text"], spans)
        assert r["n_chars"] == len(r["text"]) and not scanner.spans(r["text"])[0]
        changed += bool(spans)
    assert changed and ids(after) == ids(before)


def test_packing_stage(outputs):
    before, after = outputs["packing"]
    size = {r["doc_id"]: len(token_ids(r["text"])) for r in before.collect()}
    source = {r["doc_id"]: r["source"] for r in before.collect()}
    packed, bins = {}, {}
    for r in after.collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
        bins.setdefault(r["bin"], []).append(r)
    assert packed == size
    for members in bins.values():
        own = [source[r["doc_id"]] for r in members]
        assert sum(r["length"] for r in members) <= 2048 and len(own) == len(set(own))


def test_run_gives_the_last_stage(spark, outputs):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, outputs["packing"][1].collect()))


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= names
    assert set(ORACLES) <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()


def test_entry_without_the_subpackage(monkeypatch):
    """As if both folders and the pipeline were deleted."""
    gone = [m for m in sys.modules if re.match(r"corpus_pipeline$|marketspark\.llm(\.|$)", m)]
    for name in [*gone, "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.machinery.PathFinder.find_spec
    hide = lambda name, *a, **k: None if re.match(r"corpus_pipeline$|marketspark\.llm", name) else real(name, *a, **k)
    monkeypatch.setattr(importlib.machinery.PathFinder, "find_spec", hide)
    alone = importlib.import_module("__spark_entry__")
    assert not any(name.startswith("op") for name in alone.queries()) and "pipeline" not in alone.queries()
    assert len(alone.queries()) > 100


@pytest.mark.parametrize("package", ["ahocorasick", "sentencepiece"])
def test_entry_without_a_package_of_the_text_operators(monkeypatch, package):
    """The other queries stay, and a warning says what is missing."""
    gone = [m for m in sys.modules if re.match(rf"corpus_pipeline$|marketspark\.llm(\.|$)|{package}(\.|$)", m)]
    for name in [*gone, "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.machinery.PathFinder.find_spec
    hide = lambda name, *a, **k: None if name == package else real(name, *a, **k)
    monkeypatch.setattr(importlib.machinery.PathFinder, "find_spec", hide)
    with pytest.warns(UserWarning, match=package):
        alone = importlib.import_module("__spark_entry__")
    assert not any(name.startswith("op") for name in alone.queries()) and len(alone.queries()) > 100
