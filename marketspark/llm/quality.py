"""Quality classifier: labelled neighbours in a latent space vote.

A text becomes counts of hashed terms: the shapes of its words (letters, capitals, digits and signs,
runs shortened), pairs of neighbouring shapes, words that repeat the word before, and short words.
Counts are damped and weighted by their rarity, and projected on the main directions of a sample of
labelled rows (a truncated singular value decomposition). The sample's vectors are broadcast; their
number and length are fixed, so is the size. Every text meets all of them in blocks of exact cosine
products; the nearest ones vote, weighted by similarity.

Edge cases: a null, empty or blank text has no vector and gets the share of good rows of the sample;
without any labelled row every score is 0.5; of several labels of one id the rounded mean counts;
null labels are left out; repeated rows are scored each; a very long text is scored whole.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.common import map_slices, narrow, text_function

SAMPLE_ROWS = 4096  # labelled rows that are kept as neighbours
SHAPE_TERMS, PAIR_TERMS, WORD_TERMS = 512, 1024, 512
TERMS = SHAPE_TERMS + PAIR_TERMS + WORD_TERMS
DIRECTIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
KNOWN_WORDS = 300_000
SHORT_WORD = 4

_letters = re.compile(r"[a-zß-öø-ÿ]+")
_capitals = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_digits = re.compile(r"[0-9]+")
_runs = re.compile(r"(.)\1+")


def shape_of(word: str) -> str:
    """`Thing,` is `Aa,`; `%%%` is `%`; `2024-11` is `0-0`."""
    return _runs.sub(r"\1", _digits.sub("0", _capitals.sub("A", _letters.sub("a", word))))[:12]


class Terms:
    """Hashed term counts of texts; remembers words up to a bound."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            shape = zlib.crc32(shape_of(word).encode("utf-8", "replace")) % (SHAPE_TERMS - 1)
            plain = word.lower()
            short = zlib.crc32(plain.encode("utf-8", "replace")) % WORD_TERMS if len(plain) <= SHORT_WORD else -1
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[word] = (shape, short)
        return found

    def counts(self, text: str) -> np.ndarray:
        words = text.split()
        total = np.zeros(TERMS, np.float32)
        if not words:
            return total
        known, word = self.known, self.word
        pairs = np.array([known.get(w) or word(w) for w in words], np.int64)
        shapes, shorts = pairs[:, 0], pairs[:, 1]
        total[:SHAPE_TERMS] = np.bincount(shapes, minlength=SHAPE_TERMS)
        total[SHAPE_TERMS - 1] = sum(map(operator.eq, words, words[1:]))
        two = (shapes[:-1] * 31 + shapes[1:] * 7) % PAIR_TERMS
        total[SHAPE_TERMS : SHAPE_TERMS + PAIR_TERMS] = np.bincount(two, minlength=PAIR_TERMS)
        total[SHAPE_TERMS + PAIR_TERMS :] = np.bincount(shorts[shorts >= 0], minlength=WORD_TERMS)
        return total


@lru_cache(maxsize=1)
def terms_of_worker() -> Terms:
    return Terms()


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def damped(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Square roots of shares, weighted by rarity, at length one."""
    shares = counts / np.maximum(counts[:, : SHAPE_TERMS - 1].sum(axis=1, keepdims=True), 1)
    return unit(np.sqrt(shares, dtype=np.float32) * rarity)


def main_directions(rows: np.ndarray, wanted: int, rounds: int = 4) -> np.ndarray:
    """Truncated singular value decomposition by subspace iteration from a fixed start."""
    wanted = min(wanted, *rows.shape)
    basis = np.random.default_rng(7).standard_normal((rows.shape[1], min(wanted + 16, rows.shape[1])), np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ np.linalg.qr(basis)[0]))[0]
    _, _, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turned.T)[:, :wanted], np.float32)


@dataclass(frozen=True)
class Neighbours:
    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray  # one labelled row each, at length one
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(damped(counts, self.rarity) @ self.directions)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        result = np.full(len(counts), prior)
        if not len(self.labels):
            return result
        products = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-products, k - 1, axis=1)[:, :k]
        likeness = np.take_along_axis(products, near, axis=1).astype(np.float64)
        weight = np.maximum(likeness, 0) / (1.01 - np.minimum(likeness, 1))
        total = weight.sum(axis=1)
        voted = (total > 0) & (counts.sum(axis=1) > 0)
        result[voted] = (weight * self.labels[near]).sum(axis=1)[voted] / total[voted]
        return np.clip(result, 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray) -> Neighbours:
    seen = (counts > 0).sum(axis=0)
    rarity = np.log((len(counts) + 1) / (seen + 1)).astype(np.float32) + 0.2
    rows = damped(counts, rarity)
    directions = main_directions(rows, DIRECTIONS) if len(rows) else np.zeros((TERMS, 1), np.float32)
    return Neighbours(rarity, directions, unit(rows @ directions), labels.astype(np.float64))


def remainder(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def labelled_sample(labels: DataFrame, label_col: str, learn: Column, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label): at most `rows` labelled ids that may be learned from, in the order of a hash."""
    known = labels.where(learn & labels[id_col].isNotNull() & labels[label_col].isNotNull())
    known = known.select(known[id_col].cast("long").alias("doc_id"), known[label_col].cast("double").alias("label"))
    known = known.groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sampled_counts(docs: DataFrame, sample: DataFrame, rows: int) -> pd.DataFrame:
    """Term counts and labels of the sampled documents: at most `rows` vectors of fixed length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = terms_of_worker()
        for batch in batches:
            found = [terms.counts(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "label", "counts"]
            )

    picked = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    vectors = picked.mapInArrow(count, "doc_id long, label int, counts binary")
    return vectors.orderBy(F.xxhash64("doc_id"), "doc_id", "counts").limit(rows).toPandas()


def train(df: DataFrame, labels: DataFrame, label_col: str, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Neighbours:
    """Fit on at most `sample_rows` labelled rows; `df` is (doc_id, text), `learn` a condition on labels."""
    found = sampled_counts(df, labelled_sample(labels, label_col, learn, sample_rows), sample_rows)
    counts = np.array([np.frombuffer(c, np.float32) for c in found["counts"]], np.float32).reshape(-1, TERMS)
    return fit(counts, found["label"].to_numpy(np.float64))


def score(df: DataFrame, model: Neighbours) -> DataFrame:
    """(doc_id, text) -> doc_id, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work():
        terms = terms_of_worker()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = np.array([terms.counts(t) for t in batch.column(1).to_pylist()], np.float32)
            found = shared.value.scores(counts.reshape(-1, TERMS))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

        return each

    return map_slices(df, work, "doc_id long, score double")


def classify(
    df: DataFrame,
    labels: DataFrame,
    held_out: int = 2,
    parts: int = 4,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns only from ids outside the held-out part."""
    rows = narrow(df, id_col, text_col)
    learn = remainder(labels["doc_id"], parts) != held_out
    scored = score(rows, train(rows, labels, "quality", learn))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), parts) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    df: DataFrame,
    labels: DataFrame,
    held_out: int = 2,
    parts: int = 4,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of `df`, columns unchanged, whose score reaches the threshold."""
    learn = remainder(labels["doc_id"], parts) != held_out
    model = train(narrow(df, id_col, text_col), labels, "quality", learn)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work():
        terms = terms_of_worker()
        return lambda texts: pa.array(shared.value.scores(np.array([terms.counts(t) for t in texts], np.float32)))

    scored = text_function(work, T.DoubleType())
    return df.where(scored(F.coalesce(df[text_col].cast("string"), F.lit(""))) >= threshold)
