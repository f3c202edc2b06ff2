"""Benchmark passages against exhaustive alignment, and the bounds of the filters."""

from __future__ import annotations

import random

import numpy as np
import pytest

from marketspark.llm import decontaminate as d


def edit_distance_inside(part, text):
    """Least edits of `part` to any stretch of `text`."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(part, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.choice("sid")
        if kind == "s":
            chars[at] = rng.choice("klmnop")
        elif kind == "d":
            del chars[at]
        else:
            chars.insert(at, rng.choice("klmnop"))
    return "".join(chars)


@pytest.mark.parametrize("seed", range(4))
def test_against_exhaustive_alignment(seed):
    rng = random.Random(seed)
    items = [words(rng, rng.randint(8, 40)) for _ in range(6)]
    index = d.Index([d.make_item(i, t) for i, t in enumerate(items)])
    for _ in range(12):
        item = rng.choice(items)
        start = rng.randint(0, max(0, len(item) - 90))
        host = words(rng, 30)
        text = f"{host} {edited(rng, item[start : start + 90], rng.randint(0, 9))} {words(rng, 20)}"
        points = d.folded(text)[0]
        found = {leak[0]: leak for leak in d.leaks(index, text)}
        for one in index.items:
            parts = [one.points[k : k + one.passage] for k in range(len(one.points) - one.passage + 1)]
            least = min(edit_distance_inside(p.tolist(), points.tolist()) for p in parts[::9] + parts[-1:])
            if least <= one.edits:
                assert one.item_id in found, (least, one.edits)
        for i, leak in found.items():
            one = index.items[i]
            part = one.points[leak[3] : leak[4]]
            assert edit_distance_inside(part.tolist(), points.tolist()) == leak[5] <= one.edits
            inside = d.folded(text[leak[1] : leak[2]])[0]
            blanks = int(part[0] == d.BLANK) + int(part[-1] == d.BLANK)  # none at the edges of a text
            assert edit_distance_inside(part.tolist(), inside.tolist()) <= leak[5] + blanks


def test_folding_keeps_places():
    points, places = d.folded("  Ab,\n\tÇ—Ε  9!")
    assert "".join(map(chr, points)) == "ab ç ε 9 "
    assert [("  Ab,\n\tÇ—Ε  9!")[p] for p in places][:2] == ["A", "b"]
    assert len(d.folded("")[0]) == 0


def test_lemma():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(80))
        e = rng.randint(0, 6)
        other = edited(rng, text, e)
        mine = d.grams(np.array(list(map(ord, text)), np.uint32)).tolist()
        theirs = d.grams(np.array(list(map(ord, other)), np.uint32)).tolist()
        shared = sum(min(mine.count(g), theirs.count(g)) for g in set(mine))
        assert shared >= d.bound(80, e)


def test_table(spark, docs_of, awkward):
    rng = random.Random(1)
    items = [(0, words(rng, 30)), (1, words(rng, 9)), (2, None), (3, "tiny"), (4, ""), (5, None)]
    items[5] = (5, items[0][1])  # an equal item
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    noise = words(rng, 60)
    docs = docs_of(
        noise,
        f"{noise}\n{items[0][1].upper()}",
        f"{items[0][1][40:130]} {noise}",
        items[1][1],
        f"{noise} {items[0][1][:40]}",  # too short a part
        None,
        "",
    )
    for block in (d.BLOCK_CHARS, 60):  # one block, and several
        found = d.find_leaks(docs, bench, block_chars=block).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 0), (1, 5), (2, 0), (2, 5), (3, 1)]
        kept = d.drop_leaking(docs, bench, block_chars=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 5, 6]
    assert d.drop_leaking(awkward, bench).count() == 8
    assert d.drop_leaking(awkward, bench).columns == awkward.columns
    assert d.find_leaks(awkward, bench.limit(0)).count() == 0
    assert d.find_leaks(awkward.limit(0), bench).count() == 0
