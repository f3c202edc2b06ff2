"""SimHash near-duplicates: a binary trie joined with itself.

A fingerprint has 64 bits. Distinct fingerprints are sorted, so that a node of their trie is a range,
and two nodes are walked down together: differing bits add up, and a pair of nodes is dropped as soon
as it has more than the budget. If two fingerprints differ in `max_bits` bits, then one half has at
most half of these; so two tries are used, one beginning with each half, and the budget inside the
first half is halved. The top of the trie spreads the work: each node at a depth that follows the
number of fingerprints is one group, which also gets the nodes one bit away (or more, for a larger
budget). A crowded node is cut into blocks that meet in pairs, so no group outgrows two blocks.

Inside a group, nodes that are known to be linked already are not walked again, so a crowd of near
copies costs little more than its size. A group gives a spanning forest of its links, never all
pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.common import narrow, stored, text_function
from marketspark.llm.components import components

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
NODE_ROWS = 16_384  # fingerprints that a group should own
BLOCK_ROWS = 262_144  # a group that gets more is cut into blocks
PAIRS_AT_ONCE = 1 << 15
LEAF_PAIRS = 64
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64 bits as a signed number. A bit is set if it is set in over half of the shingle hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both
    if not found:
        return 0
    runs = [found[i:] for i in range(words)] if len(found) >= words else [[b" ".join(found)]]
    hash_of = xxhash.xxh64_intdigest
    hashes = [hash_of(b" ".join(run), SEED) for run in zip(*runs, strict=False)]
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        some = np.array(hashes[start : start + HASHES_AT_ONCE], ">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def _fingerprints():
    return lambda texts: pa.array([fingerprint(t) for t in texts], pa.int64())


def fingerprint_of(text: Column) -> Column:
    return text_function(_fingerprints, T.LongType())(text)


def labels_of(n: int, u: np.ndarray, v: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    label = np.arange(n) if start is None else start
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(label, high, low)
        while (label != (jumped := label[label])).any():
            label = jumped


def close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= max_bits


def spread(low_a, high_a, low_b, high_b) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of pairs of ranges."""
    size_b = high_b - low_b
    sizes = (high_a - low_a) * size_b
    which = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return low_a[which] + at // size_b[which], low_b[which] + at % size_b[which]


def trie_links(values: np.ndarray, own: np.ndarray, depth: int, max_bits: int) -> np.ndarray:
    """Smallest linked index for each of the sorted, distinct values (unsigned 64 bit).

    Pairs of an `own` value and any value are looked at; every value's first `depth` bits are within
    the budget of the own values'.
    """
    n = len(values)
    label = np.arange(n)
    for turn in (0, 11, 23, 37, 51):  # neighbours in a few orders: most links of a crowd, cheaply
        turned = (values << np.uint64(turn)) | (values >> np.uint64((BITS - turn) % BITS)) if turn else values
        order = np.argsort(turned, kind="stable")
        near = close(values[order[1:]], values[order[:-1]], max_bits)
        near &= own[order[1:]] | own[order[:-1]]
        label = labels_of(n, order[1:][near], order[:-1][near], label)

    mine = np.flatnonzero(own)
    left = values[mine]
    bit = lambda t: np.uint64(1 << (BITS - 1 - t))

    def changes(labels: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(0, labels[1:] != labels[:-1]))

    # nodes at `depth`: the own one against every node there
    top = values >> np.uint64(BITS - depth) if depth else np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    ends = np.append(starts[1:], n)
    base = top[mine[0]] if len(mine) else np.uint64(0)
    apart = np.bitwise_count(top[starts] ^ base).astype(np.int64)
    zero = np.zeros(len(starts), np.int64)
    stack = [(depth, zero, zero + len(left), starts, ends, apart)] if len(mine) else []
    seen_all, seen_left = changes(label), changes(label[mine])
    while stack:
        t, la, ha, lb, hb, d = stack.pop()
        if len(la) > PAIRS_AT_ONCE:
            half = len(la) // 2
            stack += [(t, *(x[:half] for x in (la, ha, lb, hb, d))), (t, *(x[half:] for x in (la, ha, lb, hb, d)))]
            continue
        one = (seen_left[ha - 1] == seen_left[la]) & (seen_all[hb - 1] == seen_all[lb])
        keep = ~(one & (label[mine[la]] == label[lb]))  # all of them are linked already
        la, ha, lb, hb, d = (x[keep] for x in (la, ha, lb, hb, d))
        small = ((ha - la) * (hb - lb) <= LEAF_PAIRS) | (t == BITS)
        if small.any():
            i, j = spread(la[small], ha[small], lb[small], hb[small])
            near = close(left[i], values[j], max_bits) & (mine[i] != j)
            if near.any():
                label = labels_of(n, mine[i[near]], j[near], label)
                seen_all, seen_left = changes(label), changes(label[mine])
            la, ha, lb, hb, d = (x[~small] for x in (la, ha, lb, hb, d))
        if not len(la):
            continue
        mask = np.uint64(((1 << t) - 1) << (BITS - t))
        ma = np.searchsorted(left, (left[la] & mask) | bit(t))
        mb = np.searchsorted(values, (values[lb] & mask) | bit(t))
        ma, mb = np.clip(ma, la, ha), np.clip(mb, lb, hb)
        budget = max_bits // 2 if t + 1 <= BITS // 2 else max_bits
        children = ((la, ma, lb, mb, d), (ma, ha, mb, hb, d), (la, ma, mb, hb, d + 1), (ma, ha, lb, mb, d + 1))
        la, ha, lb, hb, d = (np.concatenate(x) for x in zip(*children, strict=True))
        keep = (ha > la) & (hb > lb) & (d <= budget)
        if keep.any():
            stack.append((t + 1, *(x[keep] for x in (la, ha, lb, hb, d))))
    return label


def _links_of_group(max_bits: int, depth: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        turn = int(group["turn"].iloc[0])
        values = group["x"].to_numpy().view(np.uint64)
        order = np.argsort(values)
        values, own = values[order], group["own"].to_numpy()[order]
        label = trie_links(values, own, depth, max_bits)
        linked = np.flatnonzero(label != np.arange(len(label)))
        back = values if not turn else (values << np.uint64(BITS - turn)) | (values >> np.uint64(turn))
        back = back.view(np.int64)
        return pd.DataFrame({"u": back[linked], "v": back[label[linked]]})

    return work


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp) distinct -> (u, v): a spanning forest, in each group, of the links of its fingerprints."""
    n = distinct.count()
    depth = min(max(0, (n // NODE_ROWS).bit_length()), BITS // 2)
    masks = [sum(1 << b for b in bits) for k in range(max_bits // 2 + 1) for bits in combinations(range(depth), k)]
    both = [
        distinct.select(F.lit(0).alias("turn"), F.col("fp").alias("x")),
        distinct.select(
            F.lit(BITS // 2).alias("turn"),
            F.shiftleft("fp", BITS // 2)
            .bitwiseOR(F.shiftrightunsigned("fp", BITS // 2))
            .alias("x"),
        ),
    ]
    node = F.shiftrightunsigned("x", BITS - depth) if depth else F.lit(0).cast("long")
    nodes = both[0].unionByName(both[1]).withColumn("node", node)
    # an own fingerprint, or one of a node a few bits away whose number is larger
    near = F.filter(
        F.array(*(F.col("node").bitwiseXOR(F.lit(m).cast("long")) for m in masks)),
        lambda other: other <= F.col("node"),
    )
    sent = nodes.select("turn", "x", F.col("node").alias("home"), F.explode(near).alias("node"))
    blocks = sent.groupBy("turn", "node").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    sent = sent.join(blocks, ["turn", "node"]).withColumn("block", F.pmod(F.xxhash64("x"), "blocks").cast("int"))
    mine = F.col("home") == F.col("node")
    place = lambda left, right, own: F.struct(left.alias("left"), right.alias("right"), own.alias("own"))
    every, block = F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")
    # every block of own fingerprints meets every block of all: a row is on the right of each pair of
    # its column, and, if it is an own one, on the left of each pair of its row
    rights = F.transform(every, lambda i: place(i, block, mine & (i == block)))
    lefts = F.transform(F.filter(every, lambda j: mine & (j != block)), lambda j: place(block, j, F.lit(True)))
    sent = sent.select("turn", "node", "x", F.inline(F.concat(rights, lefts)))
    groups = sent.groupBy("turn", "node", "left", "right")
    return groups.applyInPandas(_links_of_group(max_bits, depth), "u long, v long")


def grouped(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp) stored rows -> (fp, root, component_id), one row for each fingerprint."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    linked = stored(components(links(distinct.select("fp"), max_bits)), "components")
    roots = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    roots = roots.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return roots.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(
    df: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Words are runs without ASCII white space; fewer words than a shingle has are one shingle; a null,
    empty or blank text has fingerprint zero and links like any other. Every row counts as a
    document, so repeated rows come back as often as they went in. A null doc_id takes part, but is
    never a component_id unless all ids of the component are null.
    """
    rows = stored(narrow(df, id_col, text_col).select("doc_id", fingerprint_of(F.col("text")).alias("fp")), "rows")
    found = rows.join(grouped(rows, max_bits), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, one for each component: the one with the smallest id, nulls last; of repeated
    rows any one."""
    fp, row = (unused(df, name) for name in ("fp", "row"))
    marked = df.withColumn(fp, fingerprint_of(F.coalesce(df[text_col].cast("string"), F.lit(""))))
    marked = stored(marked.withColumn(row, F.monotonically_increasing_id()), "marked")
    rows = marked.select(marked[id_col].cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    firsts = rows.groupBy("fp").agg(first)
    groups = grouped(rows, max_bits).select("fp", "root")
    kept = firsts.join(groups, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.row").alias(row))
    return marked.join(kept, row, "left_semi").select(*df.columns)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name
