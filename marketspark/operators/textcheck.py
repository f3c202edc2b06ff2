"""Are the numbers quoted in texts backed by known facts? A check over a table of texts.

A number is backed if one of its spellings is a spelling of a number in a fact, or is 0 to 10. Each
different number of the texts is looked up once by its spellings; the texts then meet the list of
backed numbers. The plan is the same for any number of facts and texts, and joins are split by Spark
where one number, such as a year, makes up much of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A number with thousands commas and decimals, and the counts any text may use.
NUMBER = r"\d[\d,]*(?:\.\d+)?"
SMALL_NUMBERS = range(11)

_PLACES = 8  # decimal places that are enough to round to two; what follows only breaks ties


def numbers_in(text: Column) -> Column:
    """All numbers of a text, in order, thousands separators removed; none in a missing text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda n: F.translate(n, ",", ""))


def variants(number: Column) -> Column:
    """Spellings of one number: exact without idle zeros, and rounded to 0, 1 and 2 places (half-even).

    The exact spelling is text, so it holds at any length. The rounded ones are decimals, which have
    room for 30 digits before the point; a longer number has its exact spelling only.
    """
    whole = F.regexp_replace(F.substring_index(number, ".", 1), r"^0+(?=\d)", "")
    fraction = F.regexp_extract(number, r"\.(\d+)$", 1)
    short = F.regexp_replace(fraction, "0+$", "")
    exact = F.concat(whole, F.when(short != "", F.concat(F.lit("."), short)).otherwise(""))
    sticky = F.when(F.regexp_like(F.substr(fraction, F.lit(_PLACES)), F.lit("[1-9]")), "1").otherwise("0")
    first = F.rpad(F.substring(fraction, 1, _PLACES - 1), _PLACES - 1, "0")
    value = F.concat(whole, F.lit("."), first, sticky).try_cast(f"decimal(38,{_PLACES})")
    rounded = [F.bround(value, k).cast(f"decimal(38,{k})").cast("string") for k in range(3)]
    return F.array_distinct(F.filter(F.array(exact, *rounded), lambda s: s.isNotNull()))


def extract_numbers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, number): one row for each number, in the order of the text."""
    return docs.select(key, F.posexplode(numbers_in(F.col(text))).alias("pos", "number")).select(
        key, F.col("pos").cast("bigint").alias("pos"), "number"
    )


def number_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(number, variant) for each different number of the texts."""
    numbers = extract_numbers(docs, key, text).select("number").distinct()
    return numbers.select("number", F.explode(variants(F.col("number"))).alias("variant"))


def allowed_numbers(facts: DataFrame, text: str = "text") -> DataFrame:
    """(variant): every spelling of a fact's numbers, and the small numbers, with or without facts."""
    found = facts.select(F.explode(numbers_in(F.col(text))).alias("number")).distinct()
    spelled = found.select(F.explode(variants(F.col("number"))).alias("variant"))
    small = facts.sparkSession.range(len(SMALL_NUMBERS)).select(F.col("id").cast("string").alias("variant"))
    return spelled.unionByName(small).distinct()


def backed_numbers(
    docs: DataFrame, facts: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(number): the different numbers of the texts that a fact backs."""
    spelled = number_variants(docs, key, text)
    return spelled.join(allowed_numbers(facts), "variant", "left_semi").select("number").distinct()


def unsupported_numbers(
    docs: DataFrame, facts: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, pos, number): the numbers of each text that no fact backs."""
    occurrences = extract_numbers(docs, key, text)
    return occurrences.join(backed_numbers(docs, facts, key, text), "number", "left_anti").select(
        key, "pos", "number"
    )


def number_check(
    docs: DataFrame, facts: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each text: numbers found, the unsupported ones in order, and the verdict.

    Texts are told apart by their row, so a key may repeat or be NULL.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("_text"),
        F.col(key).alias("_key"),
        numbers_in(F.col(text)).alias("_found"),
    )
    each = texts.select("_text", "_key", F.posexplode_outer("_found").alias("_pos", "_number"))
    # a text without numbers looks up a word of its own, so that these rows do not meet in one task
    each = each.withColumn("_wanted", F.coalesce("_number", F.concat(F.lit("none "), "_text")))
    backed = backed_numbers(docs, facts, key, text).select(F.col("number").alias("_backed"))
    looked_up = each.join(backed, F.col("_wanted") == F.col("_backed"), "left")
    missing = F.when(
        F.col("_number").isNotNull() & F.col("_backed").isNull(), F.struct("_pos", "_number")
    )
    checked = looked_up.groupBy("_text").agg(
        F.first("_key").alias(key),
        F.count("_number").alias("numbers_in_text"),
        F.array_sort(F.collect_list(missing)).alias("_bad"),
    )
    return checked.select(
        key,
        "numbers_in_text",
        F.array_join(F.transform("_bad", lambda b: b["_number"]), " ").alias("unsupported_numbers"),
        (F.size("_bad") == 0).alias("passed"),
    )
