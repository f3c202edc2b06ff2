"""Source divergence against the definitions in plain Python: shares, pairs, terms, shared digests."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from marketspark.llm import divergence as dv

DOCS = "doc_id bigint, text string, lang string, source string"
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(UPPER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def slow(docs, least=10, top=10):
    """All rows from the definitions, with whole numbers of any size."""
    counts, seen, in_docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source, found = lang or "", source or "", terms(text)
        counts[lang, source].update(found)
        seen[lang].update(found)
        in_docs[lang].update(set(found))
    out = []
    for lang in seen:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        v = len(kept)

        def shares(held):
            total = sum(held[t] for t in kept)
            return {t: 1 + 10**9 * (held[t] + 2) // (total + 2 * v) for t in kept}

        q, sources = shares(seen[lang]), sorted(s for known, s in counts if known == lang)
        p = {s: shares(counts[lang, s]) for s in sources}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        order = lambda rows: sorted(rows, key=lambda r: (-r[1], r[0].encode()))
        for s in sources:
            pairs = order((o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s)
            own = order((t, far(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", *row, k) for k, row in enumerate(pairs, 1)]
            out += [(lang, s, "term", *row, k) for k, row in enumerate(own[:top], 1)]
    return sorted(out)


def documents(seed, rows=300, words=60):
    dice = random.Random(seed)
    stock = [chr(97 + i % 26) + chr(0xE0 + i // 26) * (i % 3) for i in range(words)]
    docs = []
    for _ in range(rows):
        lang, source = dice.choice(["en", "en", "fr", None]), dice.choice(["a", "a", "a", "b", "ç", None, "", "z"])
        some = dice.choices(stock, weights=[1 / (1 + i) for i in range(words)], k=dice.randint(0, 12))
        text = dice.choice([" ", "-", "\n", "1"]).join(w.upper() if dice.random() < 0.3 else w for w in some)
        docs.append((text if dice.random() < 0.95 else None, lang, source))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], DOCS).repartition(3)


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definitions(spark, seed):
    docs = documents(seed)
    assert found(dv.divergence(frame(spark, docs))) == slow(docs)


def test_shared_digests_are_split(spark):
    """With digests of two bits every key is shared; answers stay, also for words that few documents have."""
    docs = documents(3)
    assert found(dv.divergence(frame(spark, docs), least_docs=3, digest_bits=2)) == slow(docs, 3)
    folded = dv.fold_terms(frame(spark, docs), "lang", "source", "text", 2)
    kept, names = dv.kept_terms(folded.cache(), 3)
    assert kept.select("key").distinct().count() == names.count() == len({r["term"] for r in names.collect()}) > 4


def test_many_blocks(spark, monkeypatch):
    """Blocks of three sources and four terms meet in all ways."""
    monkeypatch.setattr(dv, "SOURCES_AT_ONCE", 3)
    monkeypatch.setattr(dv, "TERMS_AT_ONCE", 4)
    docs = [(t, "en", f"s{i % 11}") for i, (t, _, _) in enumerate(documents(4))]
    assert found(dv.divergence(frame(spark, docs))) == slow(docs)


def test_tasks_write_out_at_a_bound(monkeypatch):
    """A task that holds few terms gives the same sums in more rows; each term's text comes once a time."""
    monkeypatch.setattr(dv, "HELD_TERMS", 5)
    sums, texts = Counter(), {}
    counts = dv.TaskCounts(64)
    docs = documents(5)
    for text, lang, source in docs:
        counts.add([lang or ""], [source or ""], pa.array([text or ""]))
        batches = list(counts.rows()) if counts.full() else []
        for row in (r for b in batches for r in b.to_pylist()):
            sums[row["lang"], row["source"], row["key"]] += row["n"] or 0
            texts.setdefault(row["key"], set()).add(row["term"])
    for row in (r for b in counts.rows() for r in b.to_pylist()):
        sums[row["lang"], row["source"], row["key"]] += row["n"] or 0
        texts.setdefault(row["key"], set()).add(row["term"])
    expected = Counter()
    for text, lang, source in docs:
        for t in terms(text):
            expected[lang or "", source or "", t] += 1
    word = {k: (t - {None}).pop() for k, t in texts.items() if k is not None}
    assert {(a, b, word[k]): n for (a, b, k), n in sums.items() if k is not None} == expected


@pytest.mark.parametrize("text", ["", "a", "A1b\x80c", "é日本 x_Y`z{k}~\x7fq\x00end", "@[A-Z]", "ß" * 1000, "😀a😀"])
def test_terms_by_bytes(text):
    rows, found = dv.terms_of(pa.array(["before Ä", text, "", "after"]).slice(1))
    got = [t for r, t in zip(rows.tolist(), found.to_pylist(), strict=True) if r == 0]
    assert got == terms(text)
    assert [t for r, t in zip(rows.tolist(), found.to_pylist(), strict=True) if r == 2] == ["after"]


def test_share_is_exact(spark):
    big = [(2**62, 2**62 + 5, 7), (0, 0, 1), (12345678901, 2**60, 2**40), (5, 0, 0)]
    df = spark.createDataFrame(big, "n long, total long, terms long")
    p = [r[0] for r in df.select(dv.share(df.n, df.total, df.terms)).collect()]
    assert p == [1 + 10**9 * (n + 2) // (t + 2 * v) if t + 2 * v else None for n, t, v in big]


def test_awkward_rows(spark, awkward):
    docs = [(r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    extra = awkward.selectExpr("*", "1 as n", "2 as key", "'x' as item", "3 as p", "4 as rank", "5 as place")
    assert found(dv.divergence(extra, least_docs=1)) == slow(docs, 1)
    assert found(dv.divergence(awkward.limit(0))) == []


def test_nothing_kept(spark):
    docs = [("a b", "en", "s"), ("", "en", "t"), (None, "fr", "s")]
    assert found(dv.divergence(frame(spark, docs))) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
