"""Near copies by similarity: texts that share at least 0.8 of their five-word shingles (Jaccard).

Minimum hashes only propose pairs: 25 bands of 4 hashes, so a pair at exactly 0.8 is missed with a
chance of 2 in a million and a closer one less often. Twice, similar sets meet in blocks of bounded
size (`blocks`), each time only as spanning forests, never as rows of pairs:

1. The texts of a band compare sketches, one byte of each of the 100 minimum hashes. A pair is
   likely if the share of equal bytes is at most five standard deviations below the similarity (a pair
   at 0.8 falls below with a chance of about one in 100,000). Likely pairs join to parts.
2. The texts of a part compare all their shingles (64-bit hashes of them). Only these links count.

With `prints`, texts that `simhash` links by their fingerprints are near copies as well, whatever their shingles
say: a group is then joined by links of either kind. A blank text has no fingerprint there.

So unlike texts that share a band cost a few bytes each, and a text's shingles are sent once for each
block that its part is cut into. A crowd of near copies costs what its size is.

Edge cases: letter case and white space don't count; fewer words than a shingle has are one shingle;
null, empty and blank texts are copies of each other; an empty table gives no rows; repeated rows and
equal texts are one set, whatever their number; very long texts are compared whole, a block holds as
many sets as fit its bytes; there are no ties, as links have no order. Columns of any name are kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.blocks import forest
from marketspark.llm.common import Scratch, stored, text_function
from marketspark.llm.components import components
from marketspark.llm.simhash import fingerprint_of, grouped, unused

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_HASHES = 25, 4
SEED = 7
HASHES_AT_ONCE = 4096
CHARS_AT_ONCE = 1 << 15
DEVIATIONS = 5

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 32, (BANDS * BAND_HASHES, 1), np.uint32) | np.uint32(1)
OFFSETS = _random.integers(0, 1 << 32, (BANDS * BAND_HASHES, 1), np.uint32)
BAND_FACTORS = _random.integers(0, 1 << 64, BAND_HASHES, np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BAND_SALTS = np.arange(1, BANDS + 1, dtype=np.uint64) * STEP


def _weights(n: int) -> np.ndarray:
    """Odd random factors of the characters of a word, by their places."""
    x = np.arange(1, n + 1, dtype=np.uint64) * STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31)) | np.uint64(1)


WEIGHTS = _weights(256)
WHITE = np.zeros(sys.maxunicode + 1, bool)  # what str.split() splits at; none stands beyond U+3000
WHITE[[i for i in range(0x3001) if chr(i).isspace()]] = True


def portions(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of some CHARS_AT_ONCE characters; a longer one stands alone."""
    some, chars = [], 0
    for text in texts:
        if some and chars + len(text) > CHARS_AT_ONCE:
            yield some
            some, chars = [], 0
        some.append(text)
        chars += len(text)
    if some:
        yield some


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, one text after the other, and where each text's words end."""
    text_ends = np.cumsum([len(text) + 1 for text in texts])
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(~WHITE.take(points))
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(starts, append=len(at))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    weights = WEIGHTS if lengths.max() <= len(WEIGHTS) else _weights(int(lengths.max()))
    values = points[at].astype(np.uint64) + np.uint64(1)
    values *= weights.take(place)
    hashes = np.add.reduceat(values, starts)
    return (hashes ^ (hashes >> np.uint64(32))) * STEP, np.searchsorted(at[starts], text_ends)


def _runs(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of every so many words in a row."""
    n = max(len(hashes) - words + 1, 0)
    runs = hashes[:n].copy()
    for i in range(1, words):
        runs = (runs ^ (runs >> np.uint64(29))) * STEP + hashes[i : i + n]
    return runs


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted, distinct hashes of the shingles of each text; none for a blank text."""
    for some in portions([(text or "").lower() for text in texts]):
        hashes, ends = word_hashes(some)
        runs, start = _runs(hashes, SHINGLE_WORDS), 0
        for end in ends.tolist():
            if end - start >= SHINGLE_WORDS:
                parts = np.sort(runs[start : end - SHINGLE_WORDS + 1])
                new = parts[1:] != parts[:-1]
                yield parts if new.all() else parts[np.append(True, new)]
            else:  # all words are one shingle
                yield _runs(hashes[start:end], end - start) if end > start else np.zeros(0, np.uint64)
            start = end


def minima(parts: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set of shingles."""
    mixed = ((parts ^ (parts >> np.uint64(31))) * STEP >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_HASHES, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(mixed), HASHES_AT_ONCE):
        np.minimum(least, (FACTORS * mixed[start : start + HASHES_AT_ONCE] + OFFSETS).min(axis=1), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """Signed keys of the bands."""
    keys = (least.reshape(BANDS, BAND_HASHES) * BAND_FACTORS).sum(axis=1) + BAND_SALTS
    keys = (keys ^ (keys >> np.uint64(32))) * STEP
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def sketch_of(least: np.ndarray) -> bytes:
    """One byte of each minimum hash."""
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def likely_at(least: float):
    """Whether sets can reach a similarity, by their sizes, and probably do, by their sketches."""
    hashes = BANDS * BAND_HASHES
    need = int(hashes * least - DEVIATIONS * (hashes * least * (1 - least)) ** 0.5)

    def likely(sketches, sizes, other_sketches, other_sizes) -> np.ndarray:
        sized = np.minimum(sizes, other_sizes) >= np.maximum(sizes, other_sizes) * (least - 1e-9)
        return sized & ((sketches == other_sketches).sum(axis=-1) >= need)

    return likely


SIGNATURE = T.StructType(
    [
        T.StructField("fp", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def _signatures():
    def each(texts: list[str | None]) -> pa.Array:
        prints, sizes, ends, bands, sketches = [], [], [0], [], []
        for parts in shingle_sets(texts):
            least = minima(parts)
            prints.append(xxhash.xxh64_intdigest(parts, SEED))
            sizes.append(len(parts))
            if len(parts):
                bands.append(bands_of(least))
            ends.append(ends[-1] + (len(bands[-1]) if len(parts) else 0))
            sketches.append(sketch_of(least))
        keys = np.concatenate([np.zeros(0, np.int64), *bands])
        columns = [
            pa.array(np.array(prints, np.uint64).view(np.int64)),
            pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys)),
            pa.array(sketches, pa.binary()),
        ]
        return pa.StructArray.from_arrays(columns, SIGNATURE.names)

    return each


def _shingle_bytes():
    return lambda texts: pa.array([parts.tobytes() for parts in shingle_sets(texts)], pa.binary())


def signed(df: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """The table, stored, with a column of (row, fp, size, bands, sketch): a number for each row, one
    that is equal for equal sets of shingles, and what is known of the set."""
    sign = text_function(_signatures, SIGNATURE)(F.coalesce(df[text_col].cast("string"), F.lit("")))
    marked = df.withColumn(name, sign)
    number = F.monotonically_increasing_id()
    return stored(marked.withColumn(name, F.col(f"`{name}`").withField("row", number)), "signed")


def print_keys(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(fp, size, text) -> (key, node) for each set in a component of linked `simhash` fingerprints of its texts."""
    some = rows.where("size > 0").select(F.col("fp").alias("node"), fingerprint_of(F.col("text")).alias("fp"))
    prints = scratch.store(some.distinct(), "prints")
    found = grouped(prints.select(F.col("node").alias("doc_id"), "fp"))
    return prints.join(found, "fp").select(F.col("root").alias("key"), "node").distinct()


def print_links(keys: DataFrame) -> DataFrame:
    """(key, node) of `print_keys` -> (u, v): all sets of a component are linked to the smallest one."""
    lowest = keys.groupBy("key").agg(F.min("node").alias("low"))
    return keys.join(lowest, "key").where("node != low").select(F.col("node").alias("u"), F.col("low").alias("v"))


def groups(
    marked: DataFrame, name: str, text_col: str = "text", least: float = SIMILARITY, prints: bool = False
) -> DataFrame:
    """Rows of `signed` -> stored (fp, root) for each fingerprint that has a near copy other than itself."""
    scratch = Scratch(marked.sparkSession)
    text = F.coalesce(marked[text_col].cast("string"), F.lit(""))
    rows = marked.select(F.inline(F.array(F.col(f"`{name}`"))), text.alias("text"))
    one = rows.drop("text").join(rows.groupBy("fp").agg(F.min("row").alias("row")), ["fp", "row"])
    one = scratch.store(one.withColumnRenamed("fp", "node"), "fingerprints")
    keys = one.select(F.explode("bands").alias("key"), "node", F.lit(0).alias("bytes"))
    likely = likely_at(least)
    parts = components(forest(scratch, keys, one.select("node", "size", "sketch"), likely))
    parts = scratch.store(parts.withColumnRenamed("root", "key"), "parts")

    chosen = one.select("node", "row", "size", "sketch").join(parts.select("node"), "node")
    whole = rows.select("row", "text").join(chosen, "row")
    whole = whole.withColumn("parts", text_function(_shingle_bytes, T.BinaryType())(F.col("text")))
    whole = scratch.store(whole.select("node", "size", "sketch", "parts"), "sets")
    keys = parts.join(whole.select("node", (F.col("size") * 8).alias("bytes")), "node").select("key", "node", "bytes")
    links = forest(scratch, keys, whole, likely, lambda a, b: similarity(a, b) >= least)
    if prints:
        links = links.unionByName(print_links(print_keys(scratch, rows)))
    found = stored(components(links), "groups").withColumnRenamed("node", "fp")
    scratch.drop()
    return found


def with_group(
    df: DataFrame, text_col: str = "text", name: str = "_group", least: float = SIMILARITY, row: str = "_row"
) -> DataFrame:
    """The table with `row`, a number for each row, and a number that near copies share; null if blank."""
    sign, fp, root = (unused(df, x) for x in ("sign", "fp", "root"))
    marked = signed(df, sign, text_col)
    found = groups(marked, sign, text_col, least).toDF(fp, root)
    marked = marked.withColumn(fp, F.col(f"`{sign}`.fp")).join(found, fp, "left")
    group = F.when(F.col(f"`{sign}`.size") > 0, F.coalesce(F.col(root), F.col(fp)))
    columns = [marked[f"`{c}`"] for c in df.columns]
    return marked.select(*columns, F.col(f"`{sign}`.row").alias(row), group.alias(name))


def drop_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, prints: bool = False
) -> DataFrame:
    """The rows of `df`, one for each group of near copies: the one with the smallest id, nulls last; of
    repeated rows any one. Blank texts are one group."""
    sign, row = unused(df, "sign"), unused(df, "row")
    marked = signed(df, sign, text_col)
    number = marked.withColumn(row, F.col(f"`{sign}`.row"))
    ids = marked.select(marked[id_col].cast("long").alias("id"), F.col(f"`{sign}`.fp").alias("fp"), F.col(f"`{sign}`.row").alias("row"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    firsts = ids.groupBy("fp").agg(first)
    found = firsts.join(groups(marked, sign, text_col, least, prints), "fp", "left")
    kept = found.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return number.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))
