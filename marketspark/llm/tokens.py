"""Token counts: prefix dynamic programming over a byte-pair vocabulary.

The vocabulary's splitter cuts a text into pieces that are merged on their own. Inside a piece the
last token of every prefix is found from shorter prefixes: it is the one token that ends there and
may follow the last token of what stands before it. One step more than there gives the exact count,
so a table of counts at every code point answers each truncation or budget question without
encoding anything again.

Two neighbours may stand side by side if merging their bytes would never join the boundary. That is
read off the two chains of parts at the boundary, each part living from its own merge to the merge
that consumes it.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a text
without any break is one long piece, still linear work; special strings count as one token each,
as the library does by default.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import map_slices, narrow

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 1024
CACHED_PIECES = 500_000
CACHED_LENGTH = 64
REMEMBERED_PAIRS = 1_000_000
NEVER = 1 << 30
#: A contraction cut short is two pieces; fixed values of the vocabulary's splitter.
CUT_CONTRACTIONS = {"'re", "'ve", "'ll"}


def byte_alphabet() -> dict[str, int]:
    """Character -> byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves,
    the others take the code points from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens by their bytes, merges, and the parts of each token, ordered by merge rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = dict.fromkeys(ids.values(), -1)
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.merged[a, b] = rank
            if whole not in self.parts:
                self.parts[whole] = (a, b)
                self.born[whole] = rank
        self.known_fits: dict[int, bool] = {}
        self._chains: dict[tuple[int, int], list[tuple[int, int]]] = {}
        ending = ahocorasick.Automaton()
        for word, token in ids.items():
            if self._reached(token):
                ending.add_word("".join(chr(alphabet[c]) for c in word), (len(word), token))
        ending.make_automaton()
        self.ending_at = ending.iter

    def _chain(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that consumes it) along one edge of a token, whole token first."""
        chain = self._chains.get((token, side))
        if chain is None:
            chain, end, part = [], NEVER, token
            while True:
                chain.append((part, end))
                if part not in self.parts:
                    break
                end, part = self.born[part], self.parts[part][side]
            self._chains[token, side] = chain
        return chain

    def fits(self, left: int, right: int) -> bool:
        """May the two tokens stand side by side in an encoding?"""
        if len(self.known_fits) > REMEMBERED_PAIRS:
            self.known_fits.clear()
        known = self.known_fits[left << 20 | right] = self._boundary_stays(left, right)
        return known

    def _boundary_stays(self, left: int, right: int, sooner_than: int = NEVER) -> bool:
        """Does no merge join the boundary of the two, up to the rank at which both are whole?"""
        before, after = self._chain(left, 1), self._chain(right, 0)
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = before[i], after[j]
            rank = self.merged.get((a, b), NEVER)
            # of equal merges the leftmost comes first: it takes `a` away, but brings `b` in
            if rank < a_end and rank <= b_end and rank < sooner_than:
                return False
            if self.born[a] > self.born[b]:
                i += 1
            elif self.born[b] >= 0:
                j += 1
            else:
                return True

    def _reached(self, token: int) -> bool:
        """Do a token's own bytes merge to it? Its two parts must come to stand side by side."""
        return token not in self.parts or self._boundary_stays(*self.parts[token], self.born[token])

    def prefixes(self, piece: bytes) -> list[int]:
        """Of every prefix, the empty one included, its number of tokens."""
        known, fits = self.known_fits, self.fits
        counts, last = [0] * (len(piece) + 1), [0] * (len(piece) + 1)
        for end, (length, token) in self.ending_at(piece.decode("latin-1")):
            end += 1
            if counts[end]:
                continue
            if start := end - length:
                fit = known.get(last[start] << 20 | token)
                if not (fits(last[start], token) if fit is None else fit):
                    continue
            counts[end] = counts[start] + 1
            last[end] = token
        return counts


class PrefixCounter:
    """Exact token counts at every code point of a text; remembers frequent pieces, up to a bound."""

    def __init__(self, path: str = VOCABULARY):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.specials)) + ")")
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Counts at each code point of one piece, as int32."""
        found = self.known.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            counts = self.vocabulary.prefixes(raw)
            if len(raw) > len(piece):  # only where a code point ends
                ends = [*(i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80), len(raw)]
                found = array("i", [counts[i] for i in ends]).tobytes()
            else:
                found = array("i", counts[1:]).tobytes()
            if len(piece) <= CACHED_LENGTH:
                if len(self.known) >= CACHED_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _plain(self, text: str) -> np.ndarray:
        """Counts at every code point of a text without special strings."""
        pieces = self.split(text)
        known = self.known
        tables = [known.get(p) or self.piece(p) for p in pieces]
        counts = np.frombuffer(b"".join(tables), np.int32).copy()
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        totals = np.cumsum(counts[ends - 1])
        counts += np.repeat(totals - counts[ends - 1], lengths).astype(np.int32)
        return counts

    def total(self, text: str) -> int:
        return int(self.counts(text, exact_inside=False)[-1]) if text else 0

    def counts(self, text: str, exact_inside: bool = True) -> np.ndarray:
        """counts[i] = tokens of text[: i + 1]; the last one is the count of the text."""
        if not text:
            return np.zeros(0, np.int32)
        if "<|" not in text:
            found = self._plain(text)
            return self._cut_pieces(text, found) if exact_inside else found
        parts, base = [], 0
        for k, part in enumerate(self.special.split(text)):
            if k % 2:  # all but the last character of a special string are ordinary text so far
                before = self._cut_pieces(part, self._plain(part))
                found = np.append(before[:-1], 1).astype(np.int32)
            elif part:
                found = self._plain(part)
                found = self._cut_pieces(part, found) if exact_inside else found
            else:
                continue
            parts.append(found + base)
            base = int(parts[-1][-1])
        found = np.concatenate(parts)
        return self._special_starts(text, found) if exact_inside else found

    def _special_starts(self, text: str, counts: np.ndarray) -> np.ndarray:
        """A prefix that ends inside a special string joins its first characters to the text before."""
        done = 0
        for match in self.special.finditer(text):
            for end in range(match.start() + 1, match.end()):
                base = int(counts[done - 1]) if done else 0
                counts[end - 1] = base + self._plain(text[done:end])[-1]
            done = match.end()
        return counts

    def _cut_pieces(self, text: str, counts: np.ndarray) -> np.ndarray:
        """Prefixes that end where the splitter would have cut otherwise: in white space before a
        word, or inside a contraction."""
        for match in SPACES.finditer(text):
            start, end = match.span()
            base = int(counts[start - 1]) if start else 0
            counts[start:end] = np.frombuffer(self.piece(match[0]), np.int32) + base
        for match in CONTRACTIONS.finditer(text):
            start = match.start()
            base = int(counts[start - 1]) if start else 0
            mark = np.frombuffer(self.piece("'"), np.int32)[0]
            if counts[start] == base + mark:  # the mark begins a piece of its own
                counts[start + 1] = base + mark + np.frombuffer(self.piece(match[0][1]), np.int32)[0]
        return counts


@lru_cache(maxsize=1)
def counter_for(path: str) -> PrefixCounter:
    """One counter in each Python worker, kept from task to task."""
    return PrefixCounter(path)


SPACES = regex.compile(r"\s{2,}(?=\S)")
CONTRACTIONS = regex.compile(r"'(?:re|ve|ll)")


def fitting_chars(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, prefix_tokens: the exact count after each code point."""

    def work():
        counter = counter_for(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            tables = [counter.counts(t) for t in texts]
            columns = [
                batch.column(0),
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array([int(t[-1]) if len(t) else 0 for t in tables], pa.int64()),
                pa.array(tables, pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "prefix_tokens"])

        return each

    schema = "doc_id long, n_bytes long, n_tokens long, prefix_tokens array<int>"
    return map_slices(narrow(df, id_col, text_col), work, schema)


def tokens_of_prefix(chars: int | Column, table: str = "prefix_tokens") -> Column:
    """Tokens of the first `chars` code points, read off a stored prefix table."""
    chars = F.least(chars if isinstance(chars, Column) else F.lit(chars), F.size(table))
    return F.when(chars <= 0, F.lit(0)).otherwise(F.element_at(table, F.greatest(chars, F.lit(1))))


def chars_within(budget: int, table: str = "prefix_tokens") -> Column:
    """Code points of the longest prefix within a budget, read off a stored prefix table."""
    flags = F.transform(table, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(flags), F.lit(0))


def count_tokens(
    df: DataFrame,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCABULARY,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fitting_chars: the longest prefix within the limit."""

    def work():
        counter = counter_for(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, totals, cuts = [], [], []
            for text in batch.column(1).to_pylist():
                raw = len(text.encode("utf-8", "surrogatepass"))
                counts = counter.counts(text, exact_inside=raw > limit)
                total = int(counts[-1]) if len(counts) else 0
                sizes.append(raw)
                totals.append(total)
                cuts.append(fitting_chars(counts, limit) if total > limit else len(text))
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array([n > limit for n in totals], pa.bool_()),
                pa.array(cuts, pa.int64()),
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"]
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    return map_slices(narrow(df, id_col, text_col), work, schema)
