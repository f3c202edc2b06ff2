"""Links between similar sets that meet under a key, decided in blocks of bounded size.

Rows are (key, node, size, sketch), or with the whole set as a further column `parts`. The rows of a
key are dealt into blocks; the key's smallest node goes into each of them. A task takes a block,
compares every pair that is not yet in one part, and gives out a spanning forest, so pairs never
become rows. For a key of several blocks, the forest tells which rows are in one part with the
smallest node. The others then meet each other and those, block by block; rows that are in that part
don't meet again. A key of n near copies thus costs n rows, and one of n rows with m outside of the
big part about n * m / BLOCK_ROWS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import Scratch
from marketspark.llm.components import components

BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20

#: (sketches, sizes, sketch or sketches, size or sizes) -> whether the sets may be similar, row by row
Likely = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: (set, set) -> whether they are similar; None: those that may be similar count as such
Similar = Callable[[np.ndarray, np.ndarray], bool] | None

NUMBERS = ("key", "one", "other", "node", "size", "part", "first", "left", "right")


def arrays_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as numpy arrays: sketches as a matrix of bytes, whole sets as buffers of the batch."""
    out = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in NUMBERS}
    sketches = batch.column("sketch")
    width = len(sketches[0].as_buffer())
    out["sketch"] = np.frombuffer(sketches.buffers()[2], np.uint8)
    begin = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset]
    out["sketch"] = out["sketch"][begin : begin + width * batch.num_rows].reshape(batch.num_rows, width)
    if "parts" in batch.schema.names:
        out["parts"] = np.empty(batch.num_rows, object)
        out["parts"][:] = [x.as_buffer() for x in batch.column("parts")]
    return out


def _same(a, b, similar: Similar) -> bool:
    return similar is None or similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))


def forest_of(rows: dict[str, np.ndarray], likely: Likely, similar: Similar) -> list[tuple[int, int]]:
    """Links (places in the block) that join all rows of its two sides that are similar, directly or
    through others, unless they are in one part already."""
    label = np.unique(rows["part"], return_inverse=True)[1]
    left, right, sketches, sizes = rows["left"], rows["right"], rows["sketch"], rows["size"]
    sets = rows.get("parts", label)
    found, open_to = [], right.copy()
    each_once = not (left & ~right).any()  # then a row has met all rows of the left after its turn
    order = np.flatnonzero(left)
    for i in order[np.argsort(~rows["first"][order], kind="stable")]:  # the key's smallest node goes first
        if each_once:
            open_to[i] = False
        others = np.flatnonzero(open_to & (label != label[i]))
        if len(others):
            for j in others[likely(sketches[others], sizes[others], sketches[i], sizes[i])]:
                if label[j] != label[i] and _same(sets[i], sets[j], similar):
                    label[label == label[j]] = label[i]
                    found.append((i, j))
    return found


def _worker(likely: Likely, similar: Similar):
    """mapInArrow function over rows sorted by (key, one, other), which name a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last block of the batch before, which may go on

        def links(rows: dict[str, np.ndarray], us: list[int], vs: list[int]) -> None:
            for i, j in forest_of(rows, likely, similar):
                us.append(int(rows["node"][i]))
                vs.append(int(rows["node"][j]))

        def made(us: list[int], vs: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrays_of(batch)
            if held is not None:
                rows = {x: np.concatenate([held[x], rows[x]]) for x in rows}
            new = np.zeros(len(rows["key"]), bool)
            new[0] = True
            for x in ("key", "one", "other"):
                new[1:] |= rows[x][1:] != rows[x][:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(starts)  # of all but the last block
            us, vs = [], []
            a = starts[:-1][sizes == 2]  # most blocks are a single pair, and those are looked at together
            b = a + 1
            apart = (rows["part"][a] != rows["part"][b]) & ((rows["left"][a] & rows["right"][b]) | (rows["left"][b] & rows["right"][a]))
            near = apart & likely(rows["sketch"][a], rows["size"][a], rows["sketch"][b], rows["size"][b])
            sets = rows.get("parts", rows["key"])
            for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                if _same(sets[i], sets[j], similar):
                    us.append(int(rows["node"][i]))
                    vs.append(int(rows["node"][j]))
            for at in np.flatnonzero(sizes > 2).tolist():
                links({x: y[starts[at] : starts[at + 1]] for x, y in rows.items()}, us, vs)
            held = {x: y[starts[-1] :].copy() for x, y in rows.items()}
            yield made(us, vs)
        if held is not None:
            us, vs = [], []
            links(held, us, vs)
            yield made(us, vs)

    return run


def _decided(rows: DataFrame, likely: Likely, similar: Similar) -> DataFrame:
    dealt = rows.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
    return dealt.mapInArrow(_worker(likely, similar), "u long, v long")


def _block_count(rows, size):
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def forest(scratch: Scratch, keys: DataFrame, payload: DataFrame, likely: Likely, similar: Similar = None) -> DataFrame:
    """(key, node, bytes) rows, each node once in a key, and (node, size, sketch[, parts]) -> stored (u, v).

    Nodes of one key that are similar, or joined by similar ones of that key, are joined by the links.
    `bytes` is what a row weighs in a task.
    """
    stats = keys.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("rows"), F.sum("bytes").alias("weight")
    )
    stats = stats.where("low != high").select("key", "low", _block_count(F.col("rows"), F.col("weight")).alias("blocks"))
    meet = scratch.store(keys.join(stats, "key"), "meet")
    yes, no = F.lit(True), F.lit(False)
    first = F.col("node") == F.col("low")
    spread = F.when(first, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node", "key"), "blocks").cast("int"))
    )
    dealt = meet.select("key", "node", F.col("node").alias("part"), first.alias("first"), F.explode(spread).alias("one"))
    dealt = dealt.select("*", F.lit(0).alias("other"), yes.alias("left"), yes.alias("right"))
    links = scratch.store(_decided(dealt.join(payload, "node"), likely, similar), "inside")
    wide = meet.where("blocks > 1")
    if wide.isEmpty():
        return links

    roots = scratch.store(components(links), "roots")
    placed = wide.join(roots, "node", "left").select("key", "node", "low", "bytes", F.coalesce("root", "node").alias("root"))
    big = placed.where("node = low").select("key", F.col("root").alias("big"))
    placed = scratch.store(placed.join(big, "key").select("key", "node", "bytes", "root", (F.col("root") == F.col("big")).alias("in_big")), "placed")
    rows_in, rows_out = F.count_if("in_big"), F.count_if(~F.col("in_big"))
    bytes_in = F.coalesce(F.sum(F.when(F.col("in_big"), F.col("bytes"))), F.lit(0))
    sides = placed.groupBy("key").agg(
        _block_count(rows_in, bytes_in).alias("ins"),
        _block_count(rows_out, F.sum("bytes") - bytes_in).alias("outs"),
        rows_out.alias("out"),
    )
    placed = placed.join(sides.where("out > 0"), "key")
    mine = F.pmod(F.xxhash64("node", "key"), F.when(F.col("in_big"), F.col("ins")).otherwise(F.col("outs"))).cast("int")
    placed = placed.withColumn("mine", mine)
    # blocks outside are numbered from 0, those inside from -1 downwards; a pair of blocks is a place
    outs, ins = F.sequence(F.lit(0), F.col("outs") - 1), F.sequence(F.lit(0), F.col("ins") - 1)
    own = F.col("mine")
    place = lambda one, other, left, right: F.struct(
        one.cast("int").alias("one"), other.cast("int").alias("other"), left.alias("left"), right.alias("right")
    )
    from_inside = F.transform(outs, lambda o: place(-own - 1, o, yes, no))
    from_outside = F.concat(
        F.transform(ins, lambda i: place(-i - 1, own, no, yes)),
        F.transform(outs, lambda o: place(F.least(o, own), F.greatest(o, own), o >= own, o <= own)),
    )
    sent = placed.select("key", "node", F.col("root").alias("part"), no.alias("first"), F.inline(F.when(F.col("in_big"), from_inside).otherwise(from_outside)))
    across = scratch.store(_decided(sent.join(payload, "node"), likely, similar), "across")
    return links.unionByName(across)
