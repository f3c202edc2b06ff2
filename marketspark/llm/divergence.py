"""Source divergence audit: how the word use of each source departs from the others of its language.

Terms are runs of letters and of all code points from U+0080, with A-Z lower-cased. A language keeps the
terms of at least `least_docs` of its documents. A source and its language give each kept term a smoothed
share p = 1 + floor(10^9 * (count + 2) / (N + 2V)), and two of them differ by f = floor((p - q)^2 / (p + q)).

Late strings: tasks fold their texts to one row for each (language, source, term), with two digests of 64 bits
instead of the term; only these and counts are shuffled. The text of a term is written once by each task,
and read again for kept terms: the least and the greatest text of each digest tell two terms that share it,
which are then split by their second digest and counted anew. Texts come back to the ranked terms alone.

Pairs of sources: the shares of a language are cut into blocks of terms and of sources. A task holds two
blocks of sources as a dense table, adds f over its terms for each pair, and gives only what differs from two
sources without the term; so terms that neither source has cost nothing.

Edge cases: null texts, languages and sources read as ''; a source without terms still takes part; a
language that keeps no term has pairs of value 0; repeated rows are documents of their own; a very long text
is worked on by itself, in time and room proportional to its length; equal values rank by the bytes of
the item; other columns are not read; an empty table gives no rows. The output has a row for each two sources
of a language, as asked, so it grows with the square of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import stored

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
BLOCK_BYTES = 8 << 20  # text that is folded at once
HELD_TERMS = 300_000  # terms that a task remembers before it writes what it has
HELD_COUNTS = 1_000_000
TERMS_AT_ONCE = 2048
SOURCES_AT_ONCE = 256
SPLITS = 8
DIGEST_BITS = 64

_IS_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


class DigestsTooAlike(Exception):
    """Two different terms have both digests in common."""


# --- counting inside a task ---


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(row of each term, the terms) of a column of texts, by classes of their UTF-8 bytes."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()).dictionary_encode()
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    inside = _IS_TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = bounds[:-1] < bounds[1:]
    first, last = bounds[:-1][filled], bounds[1:][filled] - 1
    begins[first] = inside[first]  # terms end where their text ends
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.concatenate([[0], np.cumsum(stops - starts)])
    letters = _LOWER[data[inside]]
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)])
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds))), terms.dictionary_encode()


def _folded(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different codes in order, with sums of the values."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], *(np.add.reduceat(v[order], first) for v in values)


class TaskCounts:
    """Occurrences and documents of (language, source, term) in a task, written out at a bound."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self._restart()

    def _restart(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        groups, known = self.groups, self.terms
        own = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)], np.int64)
        rows, found = terms_of(texts)
        if not len(rows):
            return
        numbers = np.array([known.setdefault(t, len(known)) for t in found.dictionary.to_pylist()], np.int64)
        size = len(numbers)
        pairs, times = np.unique(rows * size + found.indices.to_numpy(), return_counts=True)
        codes = own[pairs // size] << 32 | numbers[pairs % size]
        self.parts.append(_folded(codes, times, np.ones(len(codes), np.int64)))
        self.held += len(self.parts[-1][0])
        if self.held > HELD_COUNTS:
            self._fold()

    def _fold(self) -> None:
        if self.parts:
            self.parts = [_folded(*(np.concatenate(p) for p in zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return len(self.terms) > HELD_TERMS or self.held > HELD_COUNTS // 2 and len(self.parts) == 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row without a term for each group, then one for each group and term; starts anew."""
        self._fold()
        codes, times, docs = self.parts[0] if self.parts else [np.zeros(0, np.int64)] * 3
        terms = list(self.terms)
        digests = np.array([xxhash.xxh64_intdigest(t, 0) & self.mask for t in terms], np.uint64).view(np.int64)
        others = np.array([xxhash.xxh64_intdigest(t, 1) for t in terms], np.uint64).view(np.int64)
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        empty = len(self.groups)
        yield _rows(langs, sources, *[pa.nulls(empty, pa.int64())] * 4, pa.nulls(empty, pa.string()))
        group, term = codes >> 32, codes & 0xFFFFFFFF
        written = np.zeros(len(terms), bool)
        for start in range(0, len(codes), 65_536):
            g, t = group[start : start + 65_536], term[start : start + 65_536]
            news = np.zeros(len(t), bool)
            fresh, place = np.unique(t, return_index=True)
            news[place[~written[fresh]]] = True
            written[fresh] = True
            text = [terms[i] if new else None for i, new in zip(t.tolist(), news.tolist(), strict=True)]
            counts = times[start : start + 65_536], docs[start : start + 65_536]
            numbers = [pa.array(v) for v in (digests[t], others[t], *counts)]
            yield _rows(langs.take(pa.array(g)), sources.take(pa.array(g)), *numbers, pa.array(text, pa.string()))
        self._restart()


FOLDED = "lang string, source string, key long, other long, n long, docs long, term string"


def _rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), [field.split()[0] for field in FOLDED.split(", ")])


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BLOCK_BYTES of text each; at least one row."""
    ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def fold_terms(df: DataFrame, lang_col: str, source_col: str, text_col: str, bits: int = DIGEST_BITS) -> DataFrame:
    """(lang, source, key, other, n, docs, term): counts of each task. A term's text stands in one of its
    rows; a row without a key says that the group is there."""
    text_of = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    read = df.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TaskCounts(bits)
        for batch in batches:
            for block in _blocks(batch):
                counts.add(block.column(0).to_pylist(), block.column(1).to_pylist(), block.column(2))
                if counts.full():
                    yield from counts.rows()
        yield from counts.rows()

    return read.mapInArrow(fold, FOLDED)


# --- kept terms ---


def _kept(folded: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, key, n, lang_n) of the keys that a language keeps; one shuffle of digests and counts."""
    dealt = folded.where("key is not null").select("lang", "source", "key", "n", "docs").repartition("lang", "key")
    counted = dealt.groupBy("lang", "source", "key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "key")
    in_lang = counted.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
    return in_lang.where(F.col("lang_docs") >= least_docs).select("lang", "source", "key", "n", "lang_n")


def kept_terms(folded: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """((lang, source, key, n, lang_n), (key, term)): kept terms, no two of them under one key."""
    for level in range(1, SPLITS + 1):
        kept = stored(_kept(folded, least_docs), "kept-terms")
        texts = folded.where("term is not null").select("key", "term").join(kept.select("key").distinct(), "key", "left_semi")
        names = stored(texts.groupBy("key").agg(F.min("term").alias("term"), F.max("term").alias("last")), "term-texts")
        shared = names.where("term <> last").select("key", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return kept, names.select("key", "term")
        split = F.when(F.col("shared"), F.xxhash64(F.lit(level), "key", "other")).otherwise(F.col("key"))
        folded = stored(folded.join(shared, "key", "left").withColumn("key", split).select(*folded.columns), "split-terms")
    raise DigestsTooAlike("different terms have the same 128 bits of digest")


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a count, exact for all counts of 64 bits."""
    whole = lambda c: c.cast("decimal(19,0)")
    over = F.nullif(whole(total + 2 * terms), F.lit(0))
    product = F.lit(SCALE).cast("decimal(10,0)") * whole(n + 2)
    return F.call_function("div", product, over) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(folded: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, place, total, base, terms, lang_total): `place` numbers the sources of a language from 0,
    `base` is the share of a term that the source does not have."""
    groups = folded.where("key is null").select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "key").agg(F.max("lang_n").alias("lang_n")).groupBy("lang")
    langs = langs.agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    joined = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "terms", "lang_total")})
    return filled.withColumns({"place": place, "base": share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))})


def _shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Each count with p, the share in its source, and q, the share in its language."""
    known = kept.join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return known.withColumns({"p": p, "q": q})


# --- the two parts ---


def telling_terms(shares: DataFrame, names: DataFrame, top: int = TOP) -> DataFrame:
    """The terms by which a source departs most from its language: (lang, source, item, value, rank)."""
    group = Window.partitionBy("lang", "source")
    valued = shares.where("p > q").select("lang", "source", "key", distance(F.col("p"), F.col("q")).alias("value"))
    # all that tie with the last one stay until texts are there to order them
    near = valued.withColumn("rank", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("rank") <= top)
    order = group.orderBy(F.desc("value"), F.asc("item"))
    named = near.join(names.withColumnRenamed("term", "item"), "key")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("key")


def source_pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for each two sources of a language, a before b by their places."""
    sized = groups.select(
        "lang",
        "source",
        "place",
        F.coalesce("base", F.lit(1).cast("long")).alias("base"),
        F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS_AT_ONCE)).cast("int").alias("parts"),
        F.expr(f"max(place) over (partition by lang) div {SOURCES_AT_ONCE}").alias("last_block"),
    )
    heads = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        "lang", "part", "place", "last_block", F.lit(True).alias("head"), F.lit(0).cast("long").alias("key"), F.col("base").alias("p")
    )
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")
    where = sized.select("lang", "source", "parts", "last_block")
    cells = shares.select("lang", "source", "place", "key", "p").join(where, ["lang", "source"])
    cells = cells.select("lang", part, "place", "last_block", F.lit(False).alias("head"), "key", "p")
    own = F.expr(f"place div {SOURCES_AT_ONCE}")
    met = heads.unionByName(cells).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_block"))))
    dealt = met.select("lang", "part", F.least(own, "met").alias("x"), F.greatest(own, "met").alias("y"), "place", "head", "key", "p")

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        lang, x, y = rows["lang"].iloc[0], rows["x"].iloc[0], rows["y"].iloc[0]
        head, cell = rows[rows["head"]].sort_values("place"), rows[~rows["head"]]
        places, base = head["place"].to_numpy(), head["p"].to_numpy()
        keys, column = np.unique(cell["key"].to_numpy(), return_inverse=True)
        table = np.repeat(base[:, None], len(keys), axis=1)
        table[np.searchsorted(places, cell["place"].to_numpy()), column] = cell["p"].to_numpy()
        left = np.flatnonzero(places // SOURCES_AT_ONCE == x)
        right = np.flatnonzero(places // SOURCES_AT_ONCE == y)
        found = []
        for i in left:
            others = right[right > i]
            if len(others):
                far = (table[others] - table[i]) ** 2 // (table[others] + table[i])
                none = (base[others] - base[i]) ** 2 // (base[others] + base[i])
                found.append((np.full(len(others), places[i]), places[others], far.sum(axis=1) - len(keys) * none))
        a, b, more = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 3))
        return pd.DataFrame({"lang": lang, "a": a, "b": b, "more": more})

    schema = "lang string, a long, b long, more long"
    sums = dealt.groupBy("lang", "part", "x", "y").applyInPandas(add, schema).groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    named = lambda n: groups.select("lang", F.col("place").cast("long").alias(n), F.col("source").alias(f"{n}_source"), F.col("base").alias(f"{n}_base"), *(["terms"] if n == "a" else []))
    joined = sums.join(named("a"), ["lang", "a"]).join(named("b"), ["lang", "b"])
    nowhere = F.coalesce(F.col("terms") * distance(F.col("a_base"), F.col("b_base")), F.lit(0).cast("long"))
    return joined.select("lang", "a_source", "b_source", (nowhere + F.col("more")).alias("value"))


def divergence(
    df: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    digest_bits: int = DIGEST_BITS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term`
    the `top` kept terms that the source uses more than its language. `digest_bits` below 64 makes terms
    share digests, to try the splitting."""
    folded = stored(fold_terms(df, lang_col, source_col, text_col, digest_bits), "term-counts")
    kept, names = kept_terms(folded, least_docs)
    groups = stored(_groups(folded, kept), "term-groups")
    shares = _shares(kept, groups)
    pairs = source_pairs(shares, groups)
    both = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.select("lang", both.alias("two"), "value").select("lang", "two.source", "two.item", "value")
    parts = {"pair": pairs.withColumn("rank", F.row_number().over(order)), "term": telling_terms(shares, names, top)}
    found = [
        frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
        for part, frame in parts.items()
    ]
    return found[0].unionByName(found[1])
