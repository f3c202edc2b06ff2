"""Token files in training order.

Every text becomes token ids with an end mark, cut into sequences. A first pass counts sequences, so
each task knows the number of its first one; a second pass numbers them and sends each to its slot.
Slots come from a keyed Feistel network on a domain of even width; numbers that fall outside the
table walk on along their cycle, so the whole is a permutation of 0..n-1 that needs no state.

Slot ranges are shards. A record has a fixed stride: doc_id (8 bytes, least value for null), place of
the sequence in its text (4), number of tokens (2), the tokens (2 each) padded with zeros, and a line
feed, all little-endian. Shard k holds slots k * rows to (k + 1) * rows - 1 in order, so a reader finds
slot s at byte (s % rows) * stride and resumes anywhere. Spark's own text writer writes the bytes and
commits each task, so a lost executor leaves no half shard.

The table that is read must not change between the passes; a task whose count differs says so.

Edge cases: a null or empty text is one sequence with the end mark; repeated rows are written each;
special strings in texts are ordinary text; a very long text is many sequences; an empty table gives
no shard.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import SLICE_ROWS, folder, narrow

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END = 50_256  # free in the rank file
AHEAD = r"|\s+(?!\S)|\s+"
PLAIN = public_tokenizers.PATTERN.replace(AHEAD, r"|\s+")
#: White space as the pattern means it, which is less than Python does.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BEFORE_LAST_SPACE = re.compile(f"[{WHITE}](?=[{WHITE}][^{WHITE}])")
SEQUENCE_TOKENS = 512
SHARD_ROWS = 16_384
KEY = 0x5EED
ROUNDS = 6
HEAD = np.dtype([("doc_id", "<i8"), ("place", "<i4"), ("n", "<u2")])
NO_ID = -(1 << 63)
_MASK = (1 << 64) - 1


# --- order ---


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permuted(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each number below n: a Feistel network, walked until the result is below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    salts = [(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & _MASK for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for salt in salts:
            a, b = b, a ^ (_mixed(b, salt) & low)
        return a << np.uint64(half) | b

    found = once(numbers.astype(np.uint64))
    while (outside := found >= np.uint64(n)).any():
        found[outside] = once(found[outside])
    return found.astype(np.int64)


# --- sequences ---


@lru_cache(maxsize=4)
def encoder(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded(text: str, path: str = RANKS) -> list[int]:
    """Ids without an end mark, as `encoder` gives them, in less time.

    The pattern's one condition on what follows only says that white space before a word ends in front
    of its last character. Cut there, a text has the same tokens by a pattern without it.
    """
    plain = encoder(path, PLAIN).encode_ordinary
    ids, start = [], 0
    for cut in BEFORE_LAST_SPACE.finditer(text):
        ids += plain(text[start : cut.end()])
        start = cut.end()
    return ids + plain(text[start:]) if start else plain(text)


def token_ids(text: str, path: str = RANKS) -> np.ndarray:
    """Ids with the end mark. Lone surrogates, which UTF-8 can't hold, become a replacement mark."""
    ids = encoded(text, path)
    ids.append(END)
    return np.frombuffer(array("H", ids), np.uint16).astype("<u2", copy=False)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def sequence_counts(rows: DataFrame, tokens: int, path: str) -> dict[int, int]:
    """Number of sequences of each partition of (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for some in _slices(batches):
            total += sum(-(-(len(encoded(t, path)) + 1) // tokens) for t in some.column(1).to_pylist())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total])], ["part", "sequences"])

    return {r["part"]: r["sequences"] for r in rows.mapInArrow(count, "part long, sequences long").collect()}


def sequences(
    df: DataFrame,
    tokens: int = SEQUENCE_TOKENS,
    key: int = KEY,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = RANKS,
) -> tuple[DataFrame, int]:
    """((slot, record) of every sequence, records without padding; number of sequences)."""
    rows = narrow(df, id_col, text_col)
    counts = sequence_counts(rows, tokens, path)
    total = sum(counts.values())
    parts = np.array(sorted(counts), np.int64)
    sizes = np.array([counts[p] for p in parts.tolist()], np.int64)
    shared = df.sparkSession.sparkContext.broadcast((parts, np.cumsum(sizes) - sizes, sizes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, starts, held = shared.value
        at = int(np.searchsorted(known, TaskContext.get().partitionId()))
        number = first = int(starts[at])
        for some in _slices(batches):
            records = []
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                ids = token_ids(text, path)
                for k, start in enumerate(range(0, len(ids), tokens)):
                    cut = ids[start : start + tokens]
                    head = np.array([(NO_ID if doc is None else doc, k, len(cut))], HEAD)
                    records.append(head.tobytes() + cut.tobytes())
            slots = permuted(np.arange(number, number + len(records)), total, key)
            number += len(records)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(records, pa.binary())], ["slot", "record"])
        if number - first != held[at]:
            raise ValueError(f"the table changed: {number - first} sequences where there were {held[at]}")

    return rows.mapInArrow(place, "slot long, record binary"), total


# --- files ---


def stride_of(tokens: int) -> int:
    return HEAD.itemsize + 2 * tokens + 1


def write_shards(
    df: DataFrame,
    path: str,
    tokens: int = SEQUENCE_TOKENS,
    shard_rows: int = SHARD_ROWS,
    key: int = KEY,
    **settings,
) -> int:
    """Write all sequences to `path`/shard=k; the number of sequences."""
    found, total = sequences(df, tokens, key, **settings)
    if not total:
        return 0
    shards = -(-total // shard_rows)
    shard = F.expr(f"cast(slot div {shard_rows} as int)")
    dealt = found.withColumn("shard", shard).repartitionById(shards, F.col("shard"))
    # the writer adds the line feed; bytes that are cast to a string stay as they are
    padded = F.expr(f"cast(rpad(record, {stride_of(tokens) - 1}, X'00') as string)").alias("value")
    ordered = dealt.sortWithinPartitions("shard", "slot").select("shard", padded)
    ordered.write.partitionBy("shard").text(path)
    return total


def read_shards(
    spark: SparkSession, path: str, tokens: int = SEQUENCE_TOKENS, shard_rows: int = SHARD_ROWS, first_slot: int = 0
) -> DataFrame:
    """slot, shard, at (byte in the shard), doc_id, place, n_tokens, tokens: from a slot onwards.

    One row of a binary file is one shard; `first_slot` skips whole shards before they are read.
    """
    stride = stride_of(tokens)
    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= first_slot // shard_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                if len(raw) % stride:
                    raise ValueError(f"shard {shard} is not made of records of {stride} bytes")
                table = raw.reshape(-1, stride)
                begin = max(0, first_slot - shard * shard_rows)
                for start in range(begin, len(table), 4096):
                    yield _records(shard, shard * shard_rows, start, table[start : start + 4096], stride)

    schema = "slot long, shard int, at long, doc_id long, place int, n_tokens int, tokens binary"
    return files.select(F.col("shard").cast("int"), "content").mapInArrow(cut, schema)


def _records(shard: int, base: int, start: int, rows: np.ndarray, stride: int) -> pa.RecordBatch:
    head = np.ascontiguousarray(rows[:, : HEAD.itemsize]).view(HEAD)[:, 0]
    places = start + np.arange(len(rows))
    bodies = [row[HEAD.itemsize : HEAD.itemsize + 2 * int(n)].tobytes() for row, n in zip(rows, head["n"], strict=True)]
    ids = pa.array(head["doc_id"].astype(np.int64), pa.int64(), mask=head["doc_id"] == NO_ID)
    columns = [
        pa.array(base + places, pa.int64()),
        pa.array(np.full(len(rows), shard, np.int32)),
        pa.array(places * stride, pa.int64()),
        ids,
        pa.array(head["place"].astype(np.int32)),
        pa.array(head["n"].astype(np.int32)),
        pa.array(bodies, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["slot", "shard", "at", "doc_id", "place", "n_tokens", "tokens"])


def training_order(df: DataFrame, **settings) -> DataFrame:
    """Write shards to a new shared folder and list every record that is found in them, with a CRC of
    its tokens."""
    path = folder(df.sparkSession, "shards")
    if not write_shards(df, path, **settings):
        return df.sparkSession.createDataFrame([], "slot long, shard int, at long, doc_id long, place int, n_tokens int, crc long")
    found = read_shards(df.sparkSession, path)
    return found.select("slot", "shard", "at", "doc_id", "place", "n_tokens", F.crc32("tokens").alias("crc"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u2").tobytes())
