"""Column helpers: forgiving casts, ratios, null-aware ordering, number formats.

All of them are built from Catalyst expressions, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
INT_MIN, INT_MAX = -(2**31), 2**31 - 1

# A date needs its day, and a time needs its minutes, before it is read as a timestamp.
_TIMESTAMP_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}.*)?\s*$"
# Java number suffixes ("1d", "2f") parse as numbers in Spark but are not numbers in a data file.
_NUMBER_SUFFIX = r"[0-9.][dDfF]\s*$"


def try_double(c: Column) -> Column:
    """Text to double; anything unreadable becomes NULL."""
    return F.when(~c.rlike(_NUMBER_SUFFIX), c.try_cast("double"))


def try_int(c: Column) -> Column:
    """Text to int through double, rounding halves away from zero ('2.7' -> 3, '1e2' -> 100)."""
    rounded = F.round(try_double(c), 0)
    return F.when(rounded.between(INT_MIN, INT_MAX), rounded).try_cast("int")


def try_money(c: Column) -> Column:
    """Text to an exact two-decimal amount."""
    return c.try_cast(MONEY)


def try_timestamp(c: Column) -> Column:
    """Text to a zone-free timestamp; a bare year or year-month is not a timestamp."""
    dashed = F.translate(c, "/", "-")
    return F.when(dashed.rlike(_TIMESTAMP_SHAPE), dashed.try_cast("timestamp_ntz"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def lower_trim(c: Column) -> Column:
    return F.lower(F.trim(c))


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(c))


def pad_zip(c: Column) -> Column:
    """Restore the leading zeros of a five-digit prefix."""
    return F.lpad(F.trim(c), 5, "0")


def flag(condition: Column) -> Column:
    """Boolean to 1/0, keeping NULL as 'cannot tell'."""
    return condition.cast("int")


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")


def month_index(c: Column) -> Column:
    """Months since year 0, so a difference counts month boundaries."""
    return (F.year(c) * 12 + F.month(c)).cast("bigint")


def rounded(c: Column, digits: int) -> Column:
    """Round the scaled double half away from zero, so 1.005 (stored below 1.005) gives 1.0.

    Spark's own round() goes through the shortest decimal text and would give 1.01.
    """
    scale = float(10**digits)
    return F.round(c.cast("double") * scale, 0) / scale


def ratio(num: Column, den: Column) -> Column:
    """Double division; NULL when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column) -> Column:
    """100 * num / den; the product stays exact for integers and decimals."""
    return F.try_divide((num * 100).cast("double"), den.cast("double"))


def mean(total: Column, count: Column, digits: int) -> Column:
    return rounded(ratio(total, count), digits)


# --- text forms of numbers (half-even on the binary value) ---


def text_as(c: Column, pattern: str) -> Column:
    return F.call_function("format_number", c.cast("double"), F.lit(pattern))


def text_int(c: Column) -> Column:
    return F.format_number(c.cast("double"), 0)


def text_pct(c: Column) -> Column:
    return F.concat(text_as(c, "0.0"), F.lit("%"))


def text_two(c: Column) -> Column:
    return text_as(c, "0.00")


def text_month(c: Column) -> Column:
    return F.date_format(c, "MMM yyyy")
