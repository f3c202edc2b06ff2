"""Benchmark decontamination: shared q-grams in diagonal bands, then banded alignment.

Texts are folded (letters and digits in lower case, everything else one blank) with a map back to the
original positions. A passage is a part of an item, or a short item whole, of `passage` characters;
it leaks if it stands in a text with at most `edits` edits. By the q-gram lemma such a place shares at
least passage + 1 - q * (edits + 1) q-grams with the passage, and all of them lie on diagonals
(text place minus item place) at most `edits` apart. Two filters follow from it, and neither can lose
a leak:

1. Stretches of the text, a passage and its edits long, with enough q-grams of any item.
2. In these, hits are counted in diagonal bands, each overlapping the next by half, and in item
   blocks of twice the passage, overlapping by half. Bands and blocks that reach the bound are kept.

What is left is verified: a banded alignment of the item's block with the text around the band
looks for a passage within its edits.

The items are indexed in blocks of bounded size, each of which meets all texts; an index is small
enough to broadcast by construction, and more items only make more blocks.

Edge cases: a null or empty text leaks nothing; null items and items with fewer characters than one
q-gram after folding cannot leak; an item shorter than a passage is looked for whole, with edits in
proportion; repeated rows are searched each; equal items match each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.common import map_slices, narrow, text_function

Q = 8
PASSAGE = 80
EDITS = 6
BLOCK_CHARS = 1_000_000  # of items indexed and broadcast at a time: about 40 MB
TABLE_BITS = 22
BLANK = 32

SCHEMA = (
    "doc_id long, item_id long, start_at long, end_at long, item_start long, item_end long, edits int"
)


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Folded code point of each code point below 65,536."""
    table = np.full(1 << 16, BLANK, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points without repeated blanks, their places in the text)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = folding()[np.minimum(points, (1 << 16) - 1)]
    low = np.where(points < 1 << 16, low, points)
    blank = low == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[:1] = ~blank[:1]
    places = np.flatnonzero(keep)
    return low[places], places


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit number for every q-gram; different q-grams may share one, never the other way."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    codes = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    total = np.zeros(len(points) - q + 1, np.uint64)
    for k in range(q):
        total = total * np.uint64(0x100000001B3) + codes[k : len(points) - q + 1 + k]
    return total ^ (total >> np.uint64(29))


def bound(length: int, edits: int, q: int = Q) -> int:
    """Least number of shared q-grams of two texts `edits` apart, one of them `length` long."""
    return length + 1 - q * (edits + 1)


@dataclass(frozen=True)
class Item:
    item_id: int
    points: np.ndarray
    passage: int
    edits: int

    @property
    def least(self) -> int:
        return max(1, bound(self.passage, self.edits))


def make_item(item_id: int, text: str, passage: int = PASSAGE, edits: int = EDITS) -> Item | None:
    points = folded(text.strip())[0]
    if len(points) and points[-1] == BLANK:
        points = points[:-1]
    if len(points) < Q:
        return None
    size = min(passage, len(points))
    allowed = edits * size // passage
    while allowed and bound(size, allowed) < 1:  # the lemma must speak
        allowed -= 1
    return Item(item_id, points, size, allowed)


class Index:
    """The q-grams of some items, with a bit table that tells most strangers at once."""

    def __init__(self, items: list[Item]):
        self.items = items
        found = [grams(i.points) for i in items]
        lengths = [len(f) for f in found]
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), lengths)
        place = np.concatenate([np.arange(n) for n in lengths]) if found else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))
        self.owner, self.place = owner[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - TABLE_BITS)] = True
        self.least = min((i.least for i in items), default=0)
        self.reach = max((i.passage + i.edits for i in items), default=0)
        self.passages = np.array([i.passage for i in items], np.int64)
        self.edits = np.array([i.edits for i in items], np.int64)
        self.leasts = np.array([i.least for i in items], np.int64)

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of q-grams that items have, and the number of the q-gram in the index."""
        maybe = np.flatnonzero(self.table[found >> np.uint64(64 - TABLE_BITS)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        key = np.minimum(np.searchsorted(self.keys, found[maybe]), len(self.keys) - 1)
        real = self.keys[key] == found[maybe]
        return maybe[real], key[real]


def dense(places: np.ndarray, reach: int, least: int) -> np.ndarray:
    """Which of the sorted places lie in a stretch of `reach` with at least `least` of them."""
    if least <= 1:
        return np.ones(len(places), bool)
    if len(places) < least:
        return np.zeros(len(places), bool)
    full = np.flatnonzero(places[least - 1 :] - places[: len(places) - least + 1] < reach)
    edge = np.zeros(len(places) + 1, np.int64)
    np.add.at(edge, full, 1)
    np.add.at(edge, full + least, -1)
    return np.cumsum(edge[:-1]) > 0


def candidates(index: Index, places: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(item, item block start, its end, lowest diagonal, highest) of blocks and bands that reach the
    bound."""
    sizes = index.ends[keys] - index.starts[keys]
    at = np.repeat(places, sizes)
    flat = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(index.starts[keys], sizes)
    item, place = index.owner[flat], index.place[flat]
    diagonal = at - place
    width = 2 * (index.edits[item] + 1)  # a band; the next begins at half of it
    half = width // 2
    step = index.passages[item]
    rows = []
    for shift_d in (0, 1):
        for shift_b in (0, 1):
            band = (diagonal + shift_d * half) // width
            block = (place + shift_b * step) // (2 * step)
            rows.append(np.stack([item, band, block, np.full(len(item), shift_d), np.full(len(item), shift_b), at], 1))
    table = np.concatenate(rows)
    # a text place counts once for a band and block: an item may hold a q-gram twice
    table = table[np.lexsort(table.T[::-1])]
    fresh = np.append(True, (table[1:] != table[:-1]).any(axis=1))
    table = table[fresh]
    begins = np.append(True, (table[1:, :5] != table[:-1, :5]).any(axis=1))
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(table)))
    found = table[first]
    found = found[count >= index.leasts[found[:, 0]]]
    result = []
    for i, band, block, shift_d, shift_b, _ in found.tolist():
        one = index.items[i]
        w = 2 * (one.edits + 1)
        low = band * w - shift_d * (w // 2)
        start = (2 * block - shift_b) * one.passage
        result.append((i, max(0, start), min(len(one.points), start + 2 * one.passage + Q - 1), low, low + w - 1))
    return result


def copied(item: np.ndarray, text: np.ndarray, offset: int, low: int, high: int, passage: int):
    """(first and last place in the item, in the text) of a passage that stands there unchanged."""
    diagonals = np.arange(low, high + 1)
    at = offset + diagonals[:, None] + np.arange(len(item))[None, :]
    inside = (at >= 0) & (at < len(text))
    same = inside & (text[np.clip(at, 0, len(text) - 1)] == item[None, :])
    runs = np.cumsum(same, axis=1, dtype=np.int32)
    runs = runs[:, passage - 1 :] - np.pad(runs, ((0, 0), (1, 0)))[:, : same.shape[1] - passage + 1]
    full = np.argwhere(runs == passage)
    if not len(full):
        return None
    d, lane = (int(x) for x in full[0])
    start = offset + lane + low + d
    return offset + lane, offset + lane + passage, start, start + passage


def align(item: np.ndarray, text: np.ndarray, offset: int, low: int, high: int, passage: int, edits: int):
    """(first and last place in the item, in the text, edits) of the passage of the item that stands
    best in the text, or None if none is within its edits.

    `item` begins at place `offset`; the cells of the alignment lie on diagonals (text place - item
    place) low..high, wider by the edits on either side. All passages are aligned side by side.
    """
    if exact := copied(item, text, offset, low, high, passage):
        return *exact, 0
    low, high = low - edits, high + edits
    wide, lanes = high - low + 1, len(item) - passage + 1
    base = offset + low  # text place of the first diagonal at the first character
    around = np.full(wide + len(item), np.uint32(0xFFFFFFFF))
    a, b = max(0, base), min(len(text), base + len(around))
    if a < b:
        around[a - base : b - base] = text[a:b]
    seen = np.lib.stride_tricks.sliding_window_view(around, wide)
    cost = np.zeros((lanes, wide), np.int32)  # a match may begin on any diagonal
    slots = np.arange(wide, dtype=np.int32)
    origin = np.broadcast_to(slots, (lanes, wide))  # slot at which the match began
    for k in range(passage):
        change = cost + (seen[k : k + lanes] != item[k : k + lanes, None])
        skip = np.pad(cost[:, 1:] + 1, ((0, 0), (0, 1)), constant_values=1 << 20)  # the text lacks a character
        take = skip < change
        begin = np.where(take, np.pad(origin[:, 1:], ((0, 0), (0, 1))), origin)
        level = np.where(take, skip, change) - slots
        lowest = np.minimum.accumulate(level, axis=1)  # the text has characters too many
        source = np.maximum.accumulate(np.where(level == lowest, slots, 0), axis=1)
        cost, origin = lowest + slots, np.take_along_axis(begin, source, axis=1)
    lane, d = divmod(int(cost.argmin()), wide)
    if cost[lane, d] > edits:
        return None
    start = base + lane + int(origin[lane, d])
    end = base + lane + passage + d
    start, end = max(start, 0), min(end, len(text))
    return offset + lane, offset + lane + passage, start, end, int(cost[lane, d])


def leaks(index: Index, text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(item_id, start, end in the text, start, end in the folded item, edits), the best for each item."""
    if not index.items or len(text) < Q:
        return []
    points, origin = folded(text)
    places, keys = index.hits(grams(points))
    near = dense(places, index.reach, index.least)
    if not near.any():
        return []
    best: dict[int, tuple[int, int, int, int, int, int]] = {}
    for i, start, end, low, high in candidates(index, places[near], keys[near]):
        if i in best and best[i][5] == 0:
            continue
        one = index.items[i]
        start = max(0, min(start, end - one.passage))
        found = align(one.points[start:end], points, start, low, high, one.passage, one.edits)
        if found and (i not in best or found[4] < best[i][5]):
            a, b, s, e, cost = found
            best[i] = (one.item_id, int(origin[s]), int(origin[e - 1]) + 1, a, b, cost)
    return [best[i] for i in sorted(best)]


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block_chars`; one block at a time is on the driver."""
    rows = narrow(items, id_col, text_col)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == k)
        yield [(r["doc_id"], r["text"]) for r in some.orderBy("doc_id", "text").collect()]


def find_leaks(
    df: DataFrame,
    items: DataFrame,
    passage: int = PASSAGE,
    edits: int = EDITS,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each text and item of which it holds a passage: where, and how many edits apart."""
    spark = df.sparkSession
    rows = narrow(df, id_col, text_col)
    found = None
    for block in blocks_of(items, item_col, item_text_col, block_chars):
        made = [item for i, t in block if (item := make_item(i, t, passage, edits))]
        shared = spark.sparkContext.broadcast(Index(made))

        def work(shared=shared):
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                hits = [(d, *leak) for d, t in zip(ids, texts, strict=True) for leak in leaks(shared.value, t)]
                columns = list(zip(*hits, strict=True)) if hits else [()] * 7
                kinds = [pa.int64()] * 6 + [pa.int32()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

            return each

        part = map_slices(rows, work, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def _clean_of(shared):
    """A column function: does a text hold no passage of the broadcast items?"""

    def work():
        return lambda texts: pa.array([not leaks(shared.value, t) for t in texts], pa.bool_())

    return text_function(work, T.BooleanType())


def drop_leaking(
    df: DataFrame,
    items: DataFrame,
    passage: int = PASSAGE,
    edits: int = EDITS,
    block_chars: int = BLOCK_CHARS,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of `df`, columns unchanged, that hold no passage of any item."""
    spark = df.sparkSession
    kept = df
    for block in blocks_of(items, item_col, item_text_col, block_chars):
        made = [item for i, t in block if (item := make_item(i, t, passage, edits))]
        shared = spark.sparkContext.broadcast(Index(made))

        kept = kept.where(_clean_of(shared)(F.coalesce(df[text_col].cast("string"), F.lit(""))))
    return kept
