"""The near-copy stage drops all that the fingerprint operator links, beside what five-word shingles tell."""

from __future__ import annotations

from itertools import combinations

import corpus_pipeline
from marketspark.llm import copies, simhash

LINE = "one line of a page that comes again and again\n" * 60
TEXTS = [
    LINE + "this page ends so",
    LINE + "another page closes here",
    " ".join(f"word{i}" for i in range(300)),
    " ".join(f"word{i}" for i in range(290)),
    " ".join(f"other{i}" for i in range(300)),
    "",
    " ",
    "a short one",
]


def linked(a: str, b: str) -> tuple[bool, bool]:
    """Whether the operator links two texts, and whether their shingles do."""
    prints = simhash.fingerprint(a) ^ simhash.fingerprint(b)
    words = bool(a.strip()) == bool(b.strip())
    return words and (prints & (2**64 - 1)).bit_count() <= simhash.MAX_BITS, copies.similarity(*copies.shingle_sets([a, b])) >= copies.SIMILARITY


def kept_of(links):
    root = list(range(len(TEXTS)))
    for i, j in links:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(set(root))


def test_links_of_either_kind_count(docs_of, spark):
    pairs = {(i, j): linked(TEXTS[i], TEXTS[j]) for i, j in combinations(range(len(TEXTS)), 2)}
    assert pairs[0, 1] == (True, False) and pairs[2, 3][1]
    kept = corpus_pipeline.one_of_each(spark, docs_of(*TEXTS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == kept_of(p for p, kinds in pairs.items() if any(kinds))


def test_the_operator_links_no_two_kept_rows(docs_of, spark):
    kept = corpus_pipeline.one_of_each(spark, docs_of(*TEXTS), "")
    found = [r["component_id"] for r in simhash.near_duplicates(kept).collect()]
    assert found and len(found) == len(set(found))


def test_chains_of_both_kinds(docs_of, spark):
    """A text that shingles join to one, and fingerprints to another, joins all three; a null id and repeated rows are dropped."""
    near = TEXTS[0] + " " + "indeed"
    rows = [(5, TEXTS[1]), (3, near), (4, TEXTS[0]), (None, TEXTS[0]), (4, TEXTS[0]), (9, None)]
    kept = corpus_pipeline.one_of_each(spark, docs_of(*rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 9]
