"""Two tokenizers against their own libraries and a slow version of every count."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketspark.llm import alignment as al
from marketspark.llm.common import read


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=al.PIECES)


def byte_of():
    """Characters of a byte-level vocabulary, from the printable bytes and the others in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


BYTES = byte_of()


def encoded(libraries, text):
    """((id, start, end) of A, the same of B), empty where the bytes differ."""
    a, b = libraries
    if not text:
        return [], []
    first = a.encode(" " + text, add_special_tokens=False)
    pieces = b.encode(text)
    spelt = [bytes(BYTES[c] for c in t) for t in first.tokens]
    other = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in pieces for p in [b.id_to_piece(i)]]
    raw = (" " + text).encode()
    if b"".join(spelt) != raw or b"".join(other) != raw:
        return [], []

    def spans(ids, words):
        end, out = 0, []
        for i, w in zip(ids, words, strict=True):
            out.append((i, end, end + len(w)))
            end += len(w)
        return out

    return spans(first.ids, spelt), spans(pieces, other)


def links_of(a, b):
    return [(i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if min(x[2], y[2]) > max(x[1], y[1])]


def groups_of(a, b):
    ends = sorted({x[2] for x in a} & {y[2] for y in b})
    inside = lambda tokens, lo, hi: [t[0] for t in tokens if lo < t[2] <= hi]
    return [(inside(a, lo, hi), inside(b, lo, hi)) for lo, hi in zip([0, *ends], ends)]


def slow(libraries, docs):
    tokens = [encoded(libraries, t) for _, t in docs]
    linked = [[(a[i][0], b[j][0]) for i, j, _ in links_of(a, b)] for a, b in tokens]
    held = Counter(pair for one in linked for pair in set(one))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (number, _), (a, b), pairs in zip(docs, tokens, linked, strict=True):
        groups = groups_of(a, b)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                number,
                len(a),
                len(b),
                len(groups),
                len(pairs),
                sum(len(x) * len(y) for x, y in groups),
                hashlib.sha256(text.encode()).hexdigest() if a else "",
                sum(held[p] == most[p[0]] for p in pairs),
                sum(held[p] for p in pairs),
            )
        )
    return out


def key(row):
    return tuple((x is None, x) for x in row)


TEXTS = [
    "The quick brown fox, the quick brown fox.",
    "",
    None,
    "<|endoftext|> <s> </s> <unk> are ordinary",
    "a ▁ b",
    "  two  spaces\t\ttabs\n\n\nlines ",
    "日本語 é ß 😀👩‍👩‍👧 ﬁ Ⅷ ½ ​ \x00\x07",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30,
    "x = {'k': [1_000, 2.5e-7]}; // don't we'll they've",
    "😀" * 200,
    " ",
    "\n",
]


def random_texts(seed, n):
    dice = random.Random(seed)
    stock = ["the", "of", " ", "  ", "\n", "ing", "é", "ü", "日", "😀", "1", "23", "'s", ".", "—", " ", "qx", "Z", "\t", "<s>"]
    return ["".join(dice.choices(stock, k=dice.randint(0, 40))) for _ in range(n)]


def test_equals_the_definitions(spark, libraries, docs_of):
    docs = list(enumerate(TEXTS + random_texts(1, 150)))
    docs += [(3, TEXTS[0]), (None, TEXTS[0])]
    df = docs_of(*docs).repartition(3)
    got = al.align(df, block_bytes=700)
    assert got.columns == [*al.DOC_FIELDS, "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(slow(libraries, docs), key=key)


def test_documents(spark, libraries):
    df = read(spark, "/root/testdata/sf0.001", "documents").where("length(text) < 3000")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, al.align(df).collect())) == sorted(slow(libraries, docs))


def test_every_code_point_has_the_ids_of_the_library(libraries):
    """The rank file and the .json split and merge alike around each code point."""
    tools, points = al.tokenizers_for(al.RANKS, al.PIECES), [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for start in range(0, len(points), 50_000):
        some = [f" a{c}a 1{c}1 !{c}! {c} {c}{c}  {c}x" for c in map(chr, points[start : start + 50_000])]
        for text, one in zip(some, libraries[0].encode_batch_fast(some, add_special_tokens=False), strict=True):
            assert tools.a.encode_ordinary(text) == one.ids


def test_links_as_rows(spark, libraries, docs_of):
    docs = list(enumerate(random_texts(2, 40) + ["aaaa" * 40]))
    tokens = {n: encoded(libraries, t) for n, t in docs}
    got = defaultdict(set)
    for r in al.token_links(docs_of(*docs)).collect():
        got[r["doc_id"]].add((r["a_place"], r["b_place"], r["weight"]))
        a, b = tokens[r["doc_id"]]
        assert (a[r["a_place"]][0], b[r["b_place"]][0]) == (r["a_id"], r["b_id"])
    assert got == {n: set(links_of(a, b)) for n, (a, b) in tokens.items() if a}
    groups = Counter(r["doc_id"] for r in al.token_links(docs_of(*docs), "group").collect())
    assert groups == {n: sum(len(x) * len(y) for x, y in groups_of(a, b)) for n, (a, b) in tokens.items() if a}
    with pytest.raises(ValueError):
        al.token_links(docs_of("x"), "other")


@pytest.mark.parametrize("at_once", [1, 7, 10_000])
def test_products(at_once):
    dice = np.random.default_rng(3)
    for _ in range(20):
        a, b = (dice.integers(0, 3, (dice.integers(1, 9), 6)) * dice.integers(0, 2, (1, 6)) for _ in range(2))

        def csr(m):
            return al.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(1))]), np.nonzero(m)[1], m[m > 0], m.shape[1])

        got = np.zeros((len(a), len(b)), int)
        for i, j, v in al.products(csr(a), al.transposed(csr(b)), at_once):
            assert (v > 0).all() and not got[i, j].any()
            got[i, j] = v
        assert (got == a @ b.T).all()


def test_packed_numbers():
    values = np.array([0, 1, 254, 255, 256, 2**40, 3])
    assert al.unpacked(*al.packed(values)).tolist() == values.tolist()


def test_awkward_rows(spark, libraries, awkward):
    extra = awkward.selectExpr("*", "1 as pairs", "2 as block", "3 as pair", "4 as slot", "5 as known", "6 as n_a")
    docs = [(r["doc_id"], r["text"] if len(r["text"] or "") < 1000 else "") for r in awkward.collect()]
    short = extra.withColumn("text", F.expr("if(length(text) < 1000, text, '')"))
    assert sorted(map(tuple, al.align(short).collect()), key=key) == sorted(slow(libraries, docs), key=key)
    long = {r["doc_id"]: r for r in al.align(extra).collect()}[5]
    assert long["n_a"] > 20_000 and long["n_groups"] > 10_000 and len(long["groups_sha256"]) == 64
    assert al.align(awkward.limit(0)).collect() == []
