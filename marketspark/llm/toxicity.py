"""Toxicity: a linear-chain conditional random field tags toxic words.

Training labels are given for documents only. Token labels come from them: among a bounded sample of
labelled rows, the word or word beginning that best tells toxic from clean documents explains the
toxic documents that have it; the next one is chosen for those not explained yet, until nothing
significant is left. Tokens with such a feature, in toxic documents, are labelled toxic; the field
is then fitted to the labelled tokens by gradient ascent on its conditional likelihood.

A text's words form one chain with two tags. The forward and backward passes run over the chains of
a whole slice of texts at once: a text's first word forgets what stood before, and the products of
two-by-two steps are taken in many columns side by side. The marginals give the offending words
with their positions; a document's score is the chance that one of its three most suspect words is
toxic, each taken on its own.

Edge cases: a null, empty or wordless text has score 0 and no spans; without labelled toxic rows
every score is 0; of several labels of one id the rounded mean counts, null labels are left out;
repeated rows are scored each; a very long text is one long chain, in linear time.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import map_slices, narrow
from marketspark.llm.quality import labelled_sample, remainder
from marketspark.llm.simhash import fingerprint

SAMPLE_TOXIC = 1200  # toxic rows to learn from, and as many clean ones
SAMPLE_CLEAN = 1200
SAMPLE_CHARS = 20_000  # longer rows are not learned from (all rows are scored whole)
LEAST_SUPPORT = 6
LEAST_PURITY = 0.99
CLEAN_COST = 25  # toxic documents that must be gained for each clean one that has the feature
BEGINNINGS = (3, 4, 5)
ENDINGS = (3,)
WEIGHTS = 1 << 16
ROUNDS = 60
FIT_WORDS = 250_000
AROUND = 8
CHANCE = 0.01
COPY_BITS = 10
STEP = 1.0
DECAY = 1e-4
COLUMN = 128
TOP = 3
THRESHOLD = 0.7
SPAN_CHANCE = 0.5
KNOWN_WORDS = 300_000

WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself, its beginnings and its ending; a beginning must leave something over."""
    found = ["w" + word]
    found += [f"b{word[:n]}" for n in BEGINNINGS if len(word) > n]
    return found + [f"e{word[-n:]}" for n in ENDINGS if len(word) > n]


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % WEIGHTS


@lru_cache(maxsize=200_000)
def slots(word: str) -> tuple[int, ...]:
    return tuple(slot(f) for f in features(word))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


# --- token labels from document labels ---


def telling_features(held: list[set[str]], toxic: np.ndarray) -> set[str]:
    """Words and beginnings that explain the toxic documents, chosen one after the other."""
    clean = Counter(f for h, t in zip(held, toxic, strict=True) if not t for f in h)
    open_docs = {i for i, t in enumerate(toxic) if t}
    by_feature: dict[str, set[int]] = {}
    for i in open_docs:
        for f in held[i]:
            by_feature.setdefault(f, set()).add(i)
    by_feature = {
        f: d
        for f, d in by_feature.items()
        if len(d) >= LEAST_SUPPORT and len(d) >= LEAST_PURITY * (len(d) + clean[f])
    }
    chosen: set[str] = set()
    while by_feature:
        best = max(by_feature, key=lambda f: (len(by_feature[f]) - CLEAN_COST * clean[f], f[0] == "w", f))
        explained = by_feature[best]
        if len(explained) < LEAST_SUPPORT:
            break
        chosen.add(best)
        explained = set(explained)
        by_feature = {f: left for f, d in by_feature.items() if f != best and len(left := d - explained) >= LEAST_SUPPORT}
    return chosen


def companions(held: list[set[str]], toxic: np.ndarray) -> set[str]:
    """Features of explained documents that no clean one has, and that are too frequent for chance:
    if tags fell on documents at random, no feature of the sample would be expected to look so."""
    clean = {f for h, t in zip(held, toxic, strict=True) if not t for f in h}
    seen = Counter(f for h, t in zip(held, toxic, strict=True) if t for f in h if f not in clean)
    share = min(max(sum(toxic) / max(len(held), 1), 0.05), 0.95)
    least = max(LEAST_SUPPORT, math.ceil(math.log(max(len(seen), 1) / CHANCE) / -math.log(share)))
    return {f for f, n in seen.items() if n >= least}


def without_copies(texts: list[str], toxic: np.ndarray) -> tuple[list[str], np.ndarray]:
    """One of each group of near copies, whose shared words would pass for telling ones."""
    prints = np.array([fingerprint(t) for t in texts], np.int64).view(np.uint64)
    kept: list[int] = []
    for i in range(len(texts)):
        if not kept or np.bitwise_count(prints[kept] ^ prints[i]).min() > COPY_BITS:
            kept.append(i)
    return [texts[i] for i in kept], toxic[kept]


# --- the field ---


@dataclass(frozen=True)
class Field:
    """emission: how much each feature speaks for the toxic tag; step: log weights of tag pairs."""

    emission: np.ndarray
    bias: float
    step: np.ndarray
    first: np.ndarray

    def word(self, word: str) -> float:
        return self.bias + float(sum(self.emission[s] for s in slots(word)))


def _normal(v: np.ndarray) -> np.ndarray:
    return v / v.sum(axis=-1, keepdims=True)


def _passes(matrices: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Row vectors start @ M[0] @ ... @ M[t] for all t, each scaled to sum one."""
    n = len(matrices)
    columns = -(-n // COLUMN)
    padded = np.concatenate([matrices, np.broadcast_to(np.eye(2), (columns * COLUMN - n, 2, 2))])
    lanes = padded.reshape(columns, COLUMN, 2, 2)
    products = np.empty_like(lanes)
    now = products[:, 0] = lanes[:, 0]
    for t in range(1, COLUMN):
        m = lanes[:, t]
        now = now[:, :, 0, None] * m[:, 0, None, :] + now[:, :, 1, None] * m[:, 1, None, :]
        now = now / now.sum(axis=(1, 2), keepdims=True)
        products[:, t] = now
    carried = np.empty((columns, 2))
    v = start
    for c in range(columns):
        carried[c] = v
        v = v @ products[c, -1]
        v = v / v.sum()
    out = carried[:, None, 0, None] * products[:, :, 0] + carried[:, None, 1, None] * products[:, :, 1]
    return _normal(out.reshape(-1, 2)[:n])


def chain_marginals(scores: np.ndarray, firsts: np.ndarray, step: np.ndarray, first: np.ndarray):
    """Chance of the toxic tag for every word of the chains laid end to end, with forward and backward
    vectors. `firsts` marks where a chain begins."""
    emitted = np.stack([np.ones(len(scores)), np.exp(np.clip(scores, -30, 30))], axis=1)
    moves = np.where(firsts[:, None, None], np.exp(first)[None, None, :], np.exp(step)[None])
    matrices = moves * emitted[:, None, :]
    matrices /= matrices.sum(axis=(1, 2), keepdims=True)
    forward = _passes(matrices, np.full(2, 0.5))
    backward = np.empty_like(forward)
    backward[-1] = 0.5
    if len(scores) > 1:
        backward[:-1] = _passes(matrices[:0:-1].transpose(0, 2, 1), np.full(2, 0.5))[::-1]
    return _normal(forward * backward)[:, 1], forward, backward, emitted


def fit(chains: list[tuple[list[str], np.ndarray]]) -> Field:
    """Gradient ascent on the conditional likelihood of the tags of labelled chains of words."""
    words = [w for c, _ in chains for w in c]
    tags = np.concatenate([t for _, t in chains]).astype(np.float64)
    firsts = np.zeros(len(words), bool)
    firsts[np.cumsum([0, *(len(c) for c, _ in chains[:-1])])] = True
    held = [slots(w) for w in words]
    at = np.repeat(np.arange(len(words)), [len(h) for h in held])
    flat = np.array([s for h in held for s in h])
    used, flat = np.unique(flat, return_inverse=True)
    rate = (tags.sum() + 0.5) / (len(tags) + 1)
    emission, bias = np.zeros(len(used)), 2 * math.log(rate / (1 - rate))
    step, first = np.zeros((2, 2)), np.zeros(2)
    inner = np.flatnonzero(~firsts)
    was, now = tags[inner - 1].astype(int), tags[inner].astype(int)
    seen_step = np.zeros((2, 2))
    np.add.at(seen_step, (was, now), 1)
    seen_first = np.array([(tags[firsts] == k).sum() for k in (0, 1)])
    grown = [np.full_like(emission, 1e-6), 1e-6, np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    for _ in range(ROUNDS):
        scores = bias + np.bincount(at, emission[flat], len(words))
        chance, forward, backward, emitted = chain_marginals(scores, firsts, step, first)
        pair = forward[inner - 1][:, :, None] * np.exp(step)[None] * (emitted[inner] * backward[inner])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        start = np.array([(1 - chance[firsts]).sum(), chance[firsts].sum()])
        off = tags - chance
        slopes = [
            np.bincount(flat, off[at], len(used)) - DECAY * len(words) * emission / max(len(used), 1),
            off.sum(),
            seen_step - pair.sum(axis=0),
            seen_first - start,
        ]
        for k, slope in enumerate(slopes):
            grown[k] = grown[k] + np.square(slope)
        emission = emission + STEP * slopes[0] / np.sqrt(grown[0])
        bias += STEP * slopes[1] / math.sqrt(grown[1])
        step = step + STEP * slopes[2] / np.sqrt(grown[2])
        first = first + STEP * slopes[3] / np.sqrt(grown[3])
    whole = np.zeros(WEIGHTS)
    whole[used] = emission
    return Field(whole, bias, step, first)


NOTHING = Field(np.zeros(WEIGHTS), -60.0, np.zeros((2, 2)), np.zeros(2))


def learn(texts: list[str], toxic: np.ndarray) -> Field:
    """A field from texts with document labels."""
    if not len(texts) or not toxic.any():
        return NOTHING
    texts, toxic = without_copies(texts, toxic)
    chains = [words_of(t) for t in texts]
    held = [{f for w in set(c) for f in features(w) if f[0] != "e"} for c in chains]
    chosen = telling_features(held, toxic) | companions(held, toxic)
    labelled = []
    for chain, bad in zip(chains, toxic, strict=True):
        tags = np.zeros(len(chain), bool)
        if bad:
            tags = np.fromiter((any(f in chosen for f in features(w)) for w in chain), bool, len(chain))
            if not tags.any():
                continue  # its words can't be labelled
        labelled.append((chain, tags))
    labelled = [x for x in labelled if len(x[0])]
    if not any(tags.any() for _, tags in labelled):
        return NOTHING
    return fit(shorter(labelled))


def shorter(labelled: list[tuple[list[str], np.ndarray]]) -> list[tuple[list[str], np.ndarray]]:
    """Chains of about FIT_WORDS words in all: toxic words with what stands around them, and as much
    of the clean documents as fits."""
    parts, clean = [], []
    for chain, tags in labelled:
        if not tags.any():
            clean.append((chain, tags))
            continue
        near = np.convolve(tags, np.ones(2 * AROUND + 1), "same") > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
        parts += [(chain[a:b], tags[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    rest = max(0, FIT_WORDS - sum(len(c) for c, _ in parts)) // max(1, len(clean))
    return parts + [(c[:rest], t[:rest]) for c, t in clean if rest]


# --- scoring ---


class Tagger:
    """Marginals of texts under one field; remembers words up to a bound."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, float] = {}

    def _word(self, word: str) -> float:
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        found = self.known[word] = self.field.word(word)
        return found

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        chains = [words_of(t) for t in texts]
        known, word = self.known, self._word
        scores = np.array([s if (s := known.get(w)) is not None else word(w) for c in chains for w in c], np.float64)
        lengths = np.array([len(c) for c in chains], np.int64)
        if not len(scores):
            return [scores] * len(texts)
        firsts = np.zeros(len(scores), bool)
        firsts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        chance = chain_marginals(scores, firsts, self.field.step, self.field.first)[0]
        return np.split(chance, np.cumsum(lengths)[:-1])


def document_score(chance: np.ndarray) -> float:
    """Chance that one of the most suspect words is toxic, each on its own."""
    if len(chance) > TOP:
        chance = np.partition(chance, len(chance) - TOP)[-TOP:]
    return float(1 - np.prod(1 - chance)) if len(chance) else 0.0


def toxic_spans(text: str, chance: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs of toxic words with positions in the text (code points, end exclusive)."""
    found: list[tuple[int, int, float]] = []
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter that is two in lower case: fall back to its first
        lowered = "".join(c.lower()[0] for c in text)
    last = -2
    for i, (match, p) in enumerate(zip(WORD.finditer(lowered), chance, strict=False)):
        if p < SPAN_CHANCE:
            continue
        if last == i - 1:
            found[-1] = (found[-1][0], match.end(), max(found[-1][2], float(p)))
        else:
            found.append((*match.span(), float(p)))
        last = i
    return found


def train(df: DataFrame, labels: DataFrame, learn_from: Column) -> Field:
    """Fit on a bounded sample of labelled rows; `df` is (doc_id, text)."""
    sample = labelled_sample(labels.where("toxic = 1"), "toxic", learn_from, SAMPLE_TOXIC)
    sample = sample.unionByName(labelled_sample(labels.where("toxic = 0"), "toxic", learn_from, SAMPLE_CLEAN))
    sample = sample.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = df.join(F.broadcast(sample), "doc_id").where(F.length("text") <= SAMPLE_CHARS)
    picked = picked.select("label", "text").orderBy(F.xxhash64("text"), "text", "label")
    rows: pd.DataFrame = picked.limit(SAMPLE_TOXIC + SAMPLE_CLEAN).toPandas()
    return learn(rows["text"].tolist(), rows["label"].to_numpy() == 1)


def score(df: DataFrame, field: Field) -> DataFrame:
    """(doc_id, text) -> doc_id, score, spans: array of (start_at, end_at, chance)."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def work():
        tagger = Tagger(shared.value)
        item = pa.struct([("start_at", pa.int64()), ("end_at", pa.int64()), ("chance", pa.float64())])

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            chances = tagger.marginals(texts)
            spans = [
                [{"start_at": a, "end_at": b, "chance": p} for a, b, p in toxic_spans(t, c)]
                if len(c) and c.max() >= SPAN_CHANCE
                else []
                for t, c in zip(texts, chances, strict=True)
            ]
            columns = [batch.column(0), pa.array(map(document_score, chances), pa.float64()), pa.array(spans, pa.list_(item))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans"])

        return each

    schema = "doc_id long, score double, spans array<struct<start_at: long, end_at: long, chance: double>>"
    return map_slices(df, work, schema)


def toxicity(
    df: DataFrame,
    labels: DataFrame,
    held_out: int = 1,
    parts: int = 3,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row; learns only outside the held-out part."""
    rows = narrow(df, id_col, text_col)
    field = train(rows, labels, remainder(labels["doc_id"], parts) != held_out)
    return score(rows, field).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), parts) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "spans",
    )
