"""Best-fit packing with conflicts.

Rows are cut into pieces no longer than a bin. Pieces are spread over groups of bounded size by a
hash of their row, so that no source and no group of copies decides how large a group gets. In a
group the longest piece goes first, into the bin with the smallest residual that holds it; bins are
ordered by residual, and the search goes on to the next larger residual while a bin is in conflict:
bins carry bitmaps of the sources and of the duplicate clusters that they hold, and two pieces of
one source, or of one cluster, never share a bin. A new bin is opened only if no bin is compatible.

Edge cases: pieces of one row share its source and cluster and are kept apart; a row of length null or
0 takes a place in a bin all the same (an empty or null text is one token, the end mark); a null source or cluster is in conflict with
nothing; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.common import stored, text_function
from marketspark.llm.copies import with_group
from marketspark.llm.shards import encoded
from marketspark.llm.simhash import unused

CAPACITY = 2048  # tokens
GROUP_PIECES = 20_000
SEARCH_BINS = 64


class Bitmaps:
    """One bit for each value in each bin, kept by value: 64 values share a row of words."""

    def __init__(self, values: int, bins: int):
        self.words = np.zeros((-(-values // 64) or 1, bins), np.uint64)

    def free(self, value: int, bins: np.ndarray) -> np.ndarray:
        if value < 0:
            return np.ones(len(bins), bool)
        return (self.words[value >> 6, bins] >> np.uint64(value & 63)) & np.uint64(1) == 0

    def put(self, value: int, at: int) -> None:
        if value >= 0:
            self.words[value >> 6, at] |= np.uint64(1 << (value & 63))


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of every piece, taken in the given order. Sources and clusters are numbered
    from 0; below 0 they are in conflict with nothing."""
    n = len(lengths)
    by_source = Bitmaps(int(sources.max(initial=-1)) + 1, n)
    by_cluster = Bitmaps(int(clusters.max(initial=-1)) + 1, n)
    residual = np.empty(n, np.int64)  # of the open bins, ascending
    order = np.empty(n, np.int64)  # the bins in that order
    opened = 0
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(n):
        length, source, cluster = int(lengths[i]), int(sources[i]), int(clusters[i])
        at = int(np.searchsorted(residual[:opened], length))
        width, place = SEARCH_BINS, -1
        while at < opened:  # successors, in growing steps
            some = order[at : min(at + width, opened)]
            fits = by_source.free(source, some) & by_cluster.free(cluster, some)
            first = int(fits.argmax())
            if fits[first]:
                place = at + first
                break
            at, width = at + len(some), width * 2
        if place < 0:
            chosen, left = opened, capacity
            place, opened = opened, opened + 1
        else:
            chosen, left = int(order[place]), int(residual[place])
        bins[i], offsets[i] = chosen, capacity - left
        by_source.put(source, chosen)
        by_cluster.put(cluster, chosen)
        left -= length
        to = int(np.searchsorted(residual[:place], left))  # the bin moves down in the order
        residual[to + 1 : place + 1] = residual[to:place].copy()
        order[to + 1 : place + 1] = order[to:place].copy()
        residual[to], order[to] = left, chosen
    return bins, offsets


def numbered(values: pd.Series, only_shared: bool = False) -> np.ndarray:
    """Small numbers for equal values, -1 for null and, if asked, for values that stand alone."""
    codes = pd.factorize(values)[0]
    if only_shared and len(codes):
        counts = np.bincount(codes[codes >= 0], minlength=codes.max() + 1)
        shared = np.flatnonzero(counts > 1)
        renumber = np.full(len(counts) + 1, -1)
        renumber[shared] = np.arange(len(shared))
        codes = renumber[codes]
    return codes


def pack(
    rows: DataFrame,
    length: Column,
    source: Column,
    cluster: Column,
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
    id_col: str = "doc_id",
    row: Column | None = None,
) -> DataFrame:
    """doc_id, piece, pieces, start (in the row), length, bin, offset: one row for each piece.

    `length` counts the units of a row that a bin holds `capacity` of. `row` is a different number for
    each row, by default its place in the table.
    """
    size = F.coalesce(length.cast("long"), F.lit(0).cast("long"))
    narrow = rows.select(
        rows[id_col].cast("long").alias("doc_id"),
        size.alias("size"),
        source.cast("string").alias("source"),
        cluster.cast("long").alias("cluster"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )
    last = F.greatest(F.ceil(F.col("size") / capacity).cast("long"), F.lit(1).cast("long")) - 1
    narrow = stored(narrow.withColumn("last", last), "lengths")
    total = narrow.agg(F.sum(F.col("last") + 1)).first()[0] or 0
    groups = max(1, -(-total // group_pieces))
    pieces = narrow.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    pieces = pieces.select(
        "doc_id",
        "piece",
        (F.col("last") + 1).alias("pieces"),
        (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity).alias("length"),
        "source",
        "cluster",
        "row",
        F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int").alias("group"),
    )

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(
            group["length"].to_numpy(np.int64),
            numbered(group["source"]),
            numbered(group["cluster"], only_shared=True),
            capacity,
        )
        out = group[["doc_id", "piece", "pieces", "start", "length"]].copy()
        out["bin"] = bins + (int(group["group"].iloc[0]) << 32)
        out["offset"] = offsets
        return out

    schema = "doc_id long, piece long, pieces long, start long, length long, bin long, offset long"
    return pieces.groupBy("group").applyInPandas(work, schema)


def _tokens():
    return lambda texts: pa.array([len(encoded(t)) + 1 for t in texts], pa.int64())


def token_length(text: Column) -> Column:
    """Tokens of a text with its end mark; an empty or null text is the end mark alone."""
    return text_function(_tokens, T.LongType())(F.coalesce(text.cast("string"), F.lit("")))


def pack_texts(
    df: DataFrame,
    capacity: int = CAPACITY,
    length: Column | None = None,
    text_col: str = "text",
    source_col: str = "source",
    **settings,
) -> DataFrame:
    """Pack whole texts by their tokens, or by another length; near copies (five-word shingles,
    similarity 0.8 or more, directly or through others) and texts of one source are kept apart."""
    length = token_length(df[text_col]) if length is None else length
    name, group, row = (unused(df, x) for x in ("length", "group", "row"))
    sized = df.select("*", length.alias(name))
    rows = with_group(sized, text_col, group, row=row)
    return pack(rows, F.col(name), rows[source_col], F.col(group), capacity, row=F.col(row), **settings)
