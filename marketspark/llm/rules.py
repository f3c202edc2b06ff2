"""Quality rules: base counts, and how far a text's histograms are from its language's.

Everything is built from DataFrame functions. One pass over the texts gives the base counts and two
histograms for each row: character classes and common words. They are written to the shared folder;
the references are their sums by language over all rows that pass the base rules, and each row is
then compared with its language's reference by Jensen-Shannon distance (base 2, 0 to 1).

A row is kept if the base rules pass and neither distance is above its limit. Guards: a distance
counts only if the text has enough characters or words for a histogram, and only if the language has
a list of common words here and rows that passed.

Edge cases: a null or empty text has no words and fails the base rules; repeated rows come back each;
a null or unlisted language has no reference, so only the base rules speak; an empty table gives no
rows. A line counts as a duplicate if it has a word and an equal line stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW_WORDS = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20

#: Character classes that are counted; all other characters, mostly small letters, make one more.
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"[0-9]",
    "symbol": SYMBOLS,
    "stop": r"[.,;:!?]",
    "mark": r"[-'\"()\[\]{}/\\_=+@~^`]",
}
#: Common words of each language that has a reference.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "was", "for", "on", "with", "are"),
    "fr": ("le", "la", "de", "et", "les", "des", "un", "une", "que", "qui", "en", "pour"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "den", "von", "ein", "eine", "auf"),
    "es": ("el", "la", "de", "que", "y", "los", "las", "en", "un", "una", "por", "con"),
}
COMMON_WORDS = 12

LEAST_CHARS = 400
LEAST_HISTOGRAM_WORDS = 100
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.27


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def window_hashes(hashes: str = "hashes", n: int = WINDOW_WORDS) -> Column:
    """A hash of every window of `n` words, from the hashes of the words; none for fewer words."""
    after = lambda i: (F.get(hashes, i + k) for k in range(1, n))
    every = F.transform(hashes, lambda h, i: F.xxhash64(h, *after(i)))
    return F.slice(every, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


def ranked_windows(windows: str = "windows") -> Column:
    """Windows sorted by (hash, place from 1) if two hashes are equal, else null."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), ranked)


def repeated_words(words: str = "words", ranked: str = "ranked", n: int = WINDOW_WORDS) -> Column:
    """Words covered by windows of `n` words that stand in the text twice or more.

    Windows are compared by hash first. Only if two hashes are equal are windows sorted by (hash,
    place); neighbours with equal hash then count if their words are equal, too.
    """
    at = lambda i: F.slice(words, i, n)
    same = lambda a, b: (a["h"] == b["h"]) & (at(a["i"]) == at(b["i"]))
    pairs = F.zip_with(
        F.slice(ranked, F.lit(1), F.size(ranked) - 1),
        F.slice(ranked, F.lit(2), F.size(ranked) - 1),
        lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))
    return F.when(F.col(ranked).isNull(), 0).otherwise(_covered(starts, n))


def _covered(starts: Column, n: int) -> Column:
    """Places covered by windows of `n` that begin at sorted, distinct `starts`."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(-n).alias("last"))
    return F.aggregate(
        starts,
        zero,
        lambda s, i: F.struct((s["total"] + F.least(F.lit(n), i - s["last"])).alias("total"), i.alias("last")),
        lambda s: s["total"],
    )


def _listed(place: int) -> Column:
    """The word at a place of the language's list; empty without a list, which no word is."""
    word = F.lit("")
    for lang, words in COMMON.items():
        word = F.when(F.col("lang") == lang, F.lit(words[place])).otherwise(word)
    return word


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts and the bins of both histograms, in one pass."""
    narrow = df.select(
        df[id_col].cast("long").alias("doc_id"),
        df[lang_col].cast("string").alias("lang"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )
    split = narrow.withColumn("words", words_of(F.col("text")))
    split = split.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    split = split.withColumn("windows", window_hashes()).withColumn("ranked", ranked_windows())
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    counted = split.select(
        "doc_id",
        "lang",
        "words",
        repeated_words().cast("long").alias("n_repeat_words"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        *(F.regexp_count("text", F.lit(pattern)).cast("long").alias(f"c_{name}") for name, pattern in CLASSES.items()),
    )
    # words of any list first, each looked up once; then only these are counted by the language's own list
    listed = sorted({word for words in COMMON.values() for word in words})
    common = counted.withColumn("hits", F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(listed)))
    hits = [F.size("hits") - F.size(F.array_remove("hits", _listed(k))) for k in range(COMMON_WORDS)]
    known = [F.col(f"c_{name}") for name in CLASSES]
    return common.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        F.col("c_symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.array(*known, F.col("word_chars") - sum(known[1:], known[0])).alias("chars"),
        F.array(*hits).cast("array<long>").alias("common"),
    ).withColumn("common", F.concat("common", F.array(F.col("n_words") - _total(F.col("common"))))).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    )


def references(rows: DataFrame) -> DataFrame:
    """One row for each listed language: its bins summed over all rows that pass the base rules.

    Never more rows than languages in COMMON.
    """
    passed = rows.where(~F.col("base_failed") & F.col("lang").isin(*COMMON))
    summed = lambda bins, n: F.array(*(F.sum(F.get(bins, F.lit(i))) for i in range(n)))
    return passed.groupBy(F.col("lang").alias("of")).agg(
        summed("chars", len(CLASSES) + 1).alias("of_chars"), summed("common", COMMON_WORDS + 1).alias("of_common")
    )


def _total(bins: Column) -> Column:
    return F.aggregate(bins, F.lit(0).cast("long"), lambda a, n: a + n)


def shares(bins: Column) -> Column:
    """Each bin's part of the whole; null for an empty histogram."""
    total = _total(bins)
    return F.when(total > 0, F.transform(bins, lambda n: n / total))


def distance(one: Column, other: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty or missing."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    both = F.zip_with(shares(one), shares(other), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance, word_distance (null where guarded)."""
    rows = stored(measured(df, id_col, text_col, lang_col), "rules")
    known = F.broadcast(references(rows))
    both = rows.join(known, rows["lang"] == known["of"], "left")
    enough_chars = F.col("word_chars") >= LEAST_CHARS
    enough_words = F.col("n_words") >= LEAST_HISTOGRAM_WORDS
    compared = both.withColumns(
        {
            "char_distance": F.when(enough_chars, distance(F.col("chars"), F.col("of_chars"))),
            "word_distance": F.when(enough_words, distance(F.col("common"), F.col("of_common"))),
        }
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance
    )
    return compared.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
        "char_distance",
        "word_distance",
    )
