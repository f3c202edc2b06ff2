"""Alignment of two tokenizers: which tokens of one overlap which of the other.

Each text is encoded by A (byte-pair ranks) and B (pieces). A tokenizer's tokens cut the bytes of the text, so
token-byte incidence is a sparse matrix of ones, held in compressed rows built here. Row products by
Gustavson's rule give A * B-transposed, whose entries are overlap links with the number of shared bytes. Places where
both end a token cut the tokens into groups; products of the two token-group matrices link tokens of one group.

Corpus-wide counts: tasks fold some megabytes of texts to one row, a block, with the different id pairs of the
block, the documents that hold each, and for each document places in that list. Pairs and counts
are summed over the blocks, come back once for each block, and meet its documents there; so what is
shuffled grows with the different pairs of a block, not with tokens, and a frequent pair has as many rows as blocks.

A is `byte_bpe_50k` by its rank file, which holds the same vocabulary as the .json and gives the same ids (tests
hold the two together on all code points); B puts a space before the text, so A encodes a space and the text.

Edge cases: a null or empty text, or one whose tokens do not give back its bytes, has no tokens: zeros and an empty
string; special strings are ordinary text; repeated rows are documents of their own; a very long text is a block by
itself, with room in proportion to its length; ties for the highest count are all best; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import folder, narrow

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BLOCK_BYTES = 16 << 20  # text of one row of the stored table
ENCODE_BYTES = 1 << 20  # text that is encoded and multiplied at once
PRODUCTS_AT_ONCE = 1 << 21
ESCAPE = 255


# --- sparse matrices ---


class Csr(NamedTuple):
    """A matrix in compressed rows: columns of row i are `columns[starts[i]:starts[i + 1]]`, in order."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int


def token_bytes(ends: np.ndarray) -> Csr:
    """Incidence of tokens and bytes, from the byte at which each token ends."""
    size = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(size), np.ones(size, np.int64), size)


def token_groups(group: np.ndarray, groups: int) -> Csr:
    """Incidence of tokens and groups, from the group of each token."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    order = np.argsort(m.columns, kind="stable")
    counts = np.bincount(m.columns, minlength=m.width)
    return Csr(np.concatenate([[0], np.cumsum(counts)]), rows[order], m.values[order], len(m.starts) - 1)


def products(a: Csr, b: Csr, at_once: int = PRODUCTS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the entries of a * b, rows in order, some rows at once.

    Gustavson's rule: row i is the sum of b's rows at the columns of a's row i, each times its entry.
    A part has about `at_once` products, or one row.
    """
    lengths = np.diff(b.starts)[a.columns]
    work = np.concatenate([[0], np.cumsum(lengths)])
    row_work = work[a.starts]
    row, rows = 0, len(a.starts) - 1
    while row < rows:
        stop = min(rows, max(row + 1, int(np.searchsorted(row_work, row_work[row] + at_once, "right")) - 1))
        first, last = a.starts[row], a.starts[stop]
        times, done = lengths[first:last], work[first:last]
        steps = np.arange(work[first], work[last]) - np.repeat(done, times)
        taken = np.repeat(b.starts[a.columns[first:last]], times) + steps
        of = np.repeat(np.repeat(np.arange(row, stop), np.diff(a.starts[row : stop + 1])), times)
        values = np.repeat(a.values[first:last], times) * b.values[taken]
        codes = of * max(b.width, 1) + b.columns[taken]
        if len(codes) and (codes[1:] < codes[:-1]).any():
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        codes = codes[new]
        yield codes // max(b.width, 1), codes % max(b.width, 1), np.add.reduceat(values, new) if len(new) else values
        row = stop


# --- tokens ---


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, ranks: str, pieces: str):
        with open(ranks, "rb") as file:
            known = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for word, rank in known.items():
            self.a_bytes[rank] = word
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_lengths, self.b_lengths = (np.array([len(w) for w in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # a token with what stands behind it inside its group, then at the end of its part of the group
        count = max(len(self.a_bytes), len(self.b_bytes))
        self.count = count
        self.written = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(count)]

    def _piece(self, token: int) -> bytes:
        piece = self.b.id_to_piece(token)
        if self.b.is_byte(token):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode("utf-8")

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B; none where they do not spell a space and the text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = " " + text
            a = self.a.encode_ordinary(whole) if text else []
            raw = whole.encode("utf-8")
            spelt = text and b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((a, b) if spelt else ([], []))
        return out


@lru_cache(maxsize=1)
def tokenizers_for(ranks: str, pieces: str) -> Tokenizers:
    """One pair in each Python worker, kept from task to task."""
    return Tokenizers(ranks, pieces)


class Aligned:
    """Some texts one behind the other: their tokens, groups and links."""

    def __init__(self, tools: Tokenizers, texts: list[str]):
        encoded = tools.encode(texts)
        self.tools = tools
        self.a_count, self.b_count = (np.array([len(e[i]) for e in encoded], np.int64) for i in (0, 1))
        self.a, self.b = (np.fromiter((t for e in encoded for t in e[i]), np.int64, int(n.sum())) for i, n in ((0, self.a_count), (1, self.b_count)))
        self.a_ends, self.b_ends = np.cumsum(tools.a_lengths[self.a]), np.cumsum(tools.b_lengths[self.b])
        size = int(self.a_ends[-1]) if len(self.a) else 0
        both = np.zeros(size + 1, bool)
        both[self.a_ends] = True
        only_b = np.zeros(size + 1, bool)
        only_b[self.b_ends] = True
        both &= only_b
        before = np.cumsum(both)  # group ends up to each byte
        self.a_group, self.b_group = before[self.a_ends - 1], before[self.b_ends - 1]
        self.groups = int(before[-1])
        self.a_doc = np.repeat(np.arange(len(texts)), self.a_count)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in A, place in B, shared bytes) of each overlap link."""
        return products(token_bytes(self.a_ends), transposed(token_bytes(self.b_ends)))

    def companions(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in A, place in B, 1) of each two tokens of one group."""
        return products(token_groups(self.a_group, self.groups), transposed(token_groups(self.b_group, self.groups)))

    def group_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups, and pairs of tokens of one group, of each text."""
        in_a, in_b = (np.bincount(g, minlength=self.groups) for g in (self.a_group, self.b_group))
        first = np.flatnonzero(np.diff(self.a_group, prepend=-1))  # a group is in one text
        docs = self.a_doc[first]
        size = len(self.a_count)
        return np.bincount(docs, minlength=size), np.bincount(docs, in_a * in_b, size).astype(np.int64)

    def digests(self) -> list[str]:
        """SHA-256 of the groups of each text, written `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        count = self.tools.count
        a_last, b_last = (np.diff(g, append=-1) != 0 for g in (self.a_group, self.b_group))
        in_a, in_b = (np.bincount(g, minlength=self.groups) for g in (self.a_group, self.b_group))
        a_before, b_before = np.cumsum(in_a), np.cumsum(in_b) - in_b
        mixed = np.empty(len(self.a) + len(self.b), np.int64)
        mixed[np.arange(len(self.a)) + b_before[self.a_group]] = self.a + count * a_last
        mixed[np.arange(len(self.b)) + a_before[self.b_group]] = self.b + 2 * count * b_last
        word, stop, out = self.tools.written.__getitem__, 0, []
        for n in (self.a_count + self.b_count).tolist():
            start, stop = stop, stop + n
            text = b"".join(map(word, mixed[start:stop].tolist()))
            out.append(hashlib.sha256(text[:-1]).hexdigest() if n else "")
        return out


# --- blocks ---


def packed(values: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers as a byte each, larger ones behind an escape in a second string."""
    large = values >= ESCAPE
    return np.where(large, ESCAPE, values).astype(np.uint8).tobytes(), values[large].astype("<i8").tobytes()


def unpacked(small: bytes, large: bytes) -> np.ndarray:
    values = np.frombuffer(small, np.uint8).astype(np.int64)
    values[values == ESCAPE] = np.frombuffer(large, "<i8")
    return values


DOC_FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256")
BLOCK = (
    "block long, pairs array<long>, holders array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, n_group_links array<long>, groups_sha256 array<string>, n_pairs array<long>, "
    "hits binary, far_hits binary, times binary, many_times binary"
)
_LISTS = {"pairs": pa.int64(), "holders": pa.int64(), "groups_sha256": pa.string(), "n_pairs": pa.int64()} | dict.fromkeys(DOC_FIELDS[:-1], pa.int64())


class Block:
    """Documents of one stored row: counts of each, and its different pairs of ids with their number."""

    def __init__(self):
        self.bytes = 0
        self.docs: dict[str, list] = {name: [] for name in (*DOC_FIELDS, "n_pairs")}
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: list[int | None], found: Aligned) -> None:
        docs, codes = [], []
        for a, b, _ in found.overlaps():
            docs.append(found.a_doc[a])
            codes.append(found.a[a] << 32 | found.b[b])
        doc, code = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (docs, codes))
        size = len(ids)
        links = np.bincount(doc, minlength=size)
        order = np.argsort(code, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        doc, code = doc[order], code[order]
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])) if len(code) else np.zeros(0, np.int64)
        self.codes.append(code[new])
        self.times.append(np.diff(new, append=len(code)))
        groups, pairs = found.group_counts()
        values = (ids, found.a_count, found.b_count, groups, links, pairs, found.digests(), np.bincount(doc[new], minlength=size))
        for name, value in zip(self.docs, values, strict=True):
            self.docs[name].extend(value.tolist() if isinstance(value, np.ndarray) else value)

    def row(self, number: int) -> pa.RecordBatch:
        codes, times = np.concatenate(self.codes), np.concatenate(self.times)
        pairs, slots = np.unique(codes, return_inverse=True)
        ends = np.cumsum(np.array(self.docs["n_pairs"], np.int64))
        steps = np.diff(slots, prepend=0)  # rises inside a document
        starts = (ends - np.array(self.docs["n_pairs"], np.int64))[np.array(self.docs["n_pairs"]) > 0]
        steps[starts] = slots[starts]
        columns = {"block": pa.array([number], pa.int64())}
        lists = {"pairs": pairs, "holders": np.bincount(slots, minlength=len(pairs))} | self.docs
        columns |= {name: pa.array([values], pa.list_(_LISTS[name])) for name, values in lists.items()}
        blobs = zip(("hits", "far_hits", "times", "many_times"), (*packed(steps), *packed(times)), strict=True)
        columns |= {name: pa.array([blob], pa.binary()) for name, blob in blobs}
        return pa.RecordBatch.from_pydict(columns)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], int]]:
    """Ids and texts of about ENCODE_BYTES, and their size."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column(1)[row].as_py()
            ids.append(batch.column(0)[row].as_py())
            texts.append(text)
            size += len(text)
            if size >= ENCODE_BYTES:
                yield ids, texts, size
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size


def aligned_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pieces: str = PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of texts; see the module."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, block, number = tokenizers_for(ranks, pieces), Block(), TaskContext.get().partitionId() << 32
        for ids, texts, size in _texts(batches):
            block.add(ids, Aligned(tools, texts))
            block.bytes += size
            if block.bytes >= block_bytes:
                yield block.row(number)
                block, number = Block(), number + 1
        if block.bytes or block.codes:
            yield block.row(number)

    return narrow(df, id_col, text_col).mapInArrow(work, BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair of ids linked, and whether no pair of its A id has more.
    `pair` is A's id times 2^32 plus B's."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.pairs", "p.holders")
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # no more rows than B has ids
    return counts.withColumn("best", F.col("n") == most)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            of = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
            known = of["known"].values
            slot, n, best = (known.field(i).to_numpy(zero_copy_only=False) for i in range(3)) if known is not None else [np.zeros(0, np.int64)] * 3
            counts = np.zeros(len(slot), np.int64)
            is_best = np.zeros(len(slot), np.int64)
            counts[slot], is_best[slot] = n, best
            pairs = of["n_pairs"].values.to_numpy()
            filled = np.flatnonzero(pairs)
            starts = (np.cumsum(pairs) - pairs)[filled]
            slots = unpacked(of["hits"].as_py(), of["far_hits"].as_py())
            slots = np.cumsum(slots)
            if len(starts):
                slots -= np.repeat(np.concatenate([[0], slots[starts[1:] - 1]]), pairs[filled])
            times = unpacked(of["times"].as_py(), of["many_times"].as_py())
            sums = np.zeros((2, len(pairs)), np.int64)
            if len(starts):
                sums[0, filled] = np.add.reduceat(times * is_best[slots], starts)
                sums[1, filled] = np.add.reduceat(times * counts[slots], starts)
            columns = [of[name].values for name in DOC_FIELDS]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[0]), pa.array(sums[1])], [*DOC_FIELDS, "n_best", "count_sum"])


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best, count_sum of each document.

    n_best: its links whose pair of ids no other pair of the same A id exceeds in documents; count_sum: documents that
    hold the pair, summed over its links.
    """
    spark = df.sparkSession
    path, work = folder(spark, "aligned"), aligned_blocks(df, id_col, text_col, **settings)
    work.write.option("compression", "zstd").parquet(path)  # small steps between places pack well
    blocks = spark.read.schema(work.schema).parquet(path)
    cells = blocks.select("block", F.posexplode("pairs").alias("slot", "pair"))
    known = cells.join(pair_counts(blocks), "pair").groupBy("block").agg(F.collect_list(F.struct("slot", "n", "best")).alias("known"))
    joined = blocks.drop("pairs", "holders").join(known, "block", "left")
    return joined.mapInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, n_best long, count_sum long")


def token_links(df: DataFrame, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pieces: str = PIECES) -> DataFrame:
    """(doc_id, row, a_place, b_place, a_id, b_id, weight) of each link: `overlap` weighs shared bytes, `group` has all
    tokens of A and B between two common ends. `row` numbers the texts of a task, for ids that repeat.
    """
    if kind not in ("overlap", "group"):
        raise ValueError(f"no such links: {kind}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, row = tokenizers_for(ranks, pieces), 0
        for ids, texts, _ in _texts(batches):
            found = Aligned(tools, texts)
            a_first, b_first = (np.cumsum(n) - n for n in (found.a_count, found.b_count))
            keys = pa.array(ids, pa.int64())
            for a, b, weight in found.overlaps() if kind == "overlap" else found.companions():
                doc = found.a_doc[a]
                columns = [keys.take(pa.array(doc))]
                columns += [pa.array(v) for v in (row + doc, a - a_first[doc], b - b_first[doc], found.a[a], found.b[b], weight)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "a_place", "b_place", "a_id", "b_id", "weight"])
            row += len(ids)

    return narrow(df, id_col, text_col).mapInArrow(work, "doc_id long, row long, a_place long, b_place long, a_id long, b_id long, weight long")
