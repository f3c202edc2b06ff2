"""Order statistics that never sort a whole table, or a whole hot group, in one task.

`first_per_key` plans as WindowGroupLimit below the exchange, so a hot key ships at most one
row from each map task. `exact_median` and `global_rank` work on value counts: equal values
collapse before the first shuffle, and a fixed-width magnitude histogram (at most 4096 steps for
each power of two) tells every band of values how many rows lie below it. Only that histogram is
ever ordered as a whole. The median then cuts its one or two middle bands by 20 further bits of the
value. A double has 52, so at most 2^20 different ones are left to be ordered in one task, and at
most 2^20 cuts of a band, however many values crowd there.

`first_per_key_by` is for large tables whose tasks read more rows than they can sort in memory, `distinct_rows` for
large tables where few rows have a copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More rows than this of one value are a crowd: they don't meet in one task. N rows have at most N/1024 such values.
CROWD = 1024
_STEP_BITS = 12
_FINE_BITS = 20
_CODE_BITS = 14
_LOWEST, _HIGHEST = -40, 1000
_NULL_BAND = -(2**62)
_NAN_BAND = 2**62
_ENDLESS = 2**61


def first_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Keep the first row of each key in the order given ("column" or "column desc", NULLs last).

    The remaining columns break every tie.
    """
    named = {column: "desc" in rest for column, *rest in (o.split() for o in order)}
    named |= {c: False for c in df.columns if c not in named and c not in keys}
    by = [
        F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
        for c, descending in named.items()
    ]
    ordered = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_n", F.row_number().over(ordered)).filter("_n = 1").drop("_n")


def crowds(df: DataFrame, by: str, most: int = CROWD) -> DataFrame:
    """(_mark): the 64-bit digests of a column that more than `most` rows have; they fold to a count before the shuffle."""
    folded = df.groupBy(F.xxhash64(by).alias("_mark")).agg(F.count(F.lit(1)).alias("_n"))
    return folded.filter(F.col("_n") > most).select("_mark")


def first_per_key_by(df: DataFrame, by: str, keys: Sequence[str], *order: str, crowded: DataFrame | None = None) -> DataFrame:
    """`first_per_key` where `by` is one of the keys: rows meet by that column, so it lies together in the result.

    Rows are sorted after the shuffle, in parts that Spark sizes, and not in the tasks that read them. Only values that
    very many rows have, `crowded`, go by `first_per_key`, which sends one row of each key from each task. Digests that
    merely meet put a value among the crowded ones, where it gets the same rows.
    """
    crowded = crowds(df, by) if crowded is None else crowded
    calm = first_of_calm(df, by, keys, *order, crowded=crowded)
    return calm.unionByName(first_per_key(with_marks(df, by, crowded), keys, *order))


def first_of_calm(df: DataFrame, by: str, keys: Sequence[str], *order: str, crowded: DataFrame) -> DataFrame:
    """The rows of `first_per_key_by` whose value of `by` is not crowded: they lie together, and no value has many."""
    calm = with_marks(df, by, crowded, "left_anti")
    return first_per_key(calm.repartition(F.col(by)), keys, *order)


def with_marks(df: DataFrame, by: str, marks: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose digest of a column is among the marks; with "left_anti", the others."""
    return df.withColumn("_mark", F.xxhash64(by)).join(marks, "_mark", how).select(*df.columns)


def marks_of_copies(df: DataFrame) -> DataFrame:
    """(_mark): the 64-bit digests that more than one row has. A row with any other digest has no equal row."""
    return crowds(df.select(F.xxhash64(*df.columns).alias("_row")), "_row", 1)


def distinct_rows(df: DataFrame, marks: DataFrame) -> DataFrame:
    """DISTINCT that compares only rows with the digests of `marks_of_copies`; the others keep their place.

    It pays if the marks are few enough to broadcast: no other row is then hashed, sorted or shuffled.
    """
    marked = df.withColumn("_mark", F.xxhash64(F.xxhash64(*df.columns)))
    alone = marked.join(marks, "_mark", "left_anti").select(*df.columns)
    return alone.unionByName(marked.join(marks, "_mark", "left_semi").select(*df.columns).distinct())


def _step(value: Column) -> tuple[Column, Column, Column]:
    """(size scaled so that a band is one wide, the band's step as a whole number, power of two of the size)."""
    size = F.abs(value.cast("double"))
    finite = size < F.lit(float("inf"))
    power = F.floor(F.log2(F.when(finite & (size > 0), size))).cast("int")
    power = F.greatest(F.lit(_LOWEST), F.least(F.lit(_HIGHEST), power))
    scaled = F.when(finite, size) * F.pow(F.lit(2.0), _STEP_BITS - power)
    step = F.least(F.floor(scaled).try_cast("bigint"), F.lit(2**_CODE_BITS - 1).cast("bigint"))
    return scaled, step, power


def magnitude_band(value: Column) -> Column:
    """A bigint that never decreases as the value grows: sign, power of two, 4096 linear steps.

    The infinities have bands of their own at either end, NaN one above all, as Spark sorts it.
    The number of different bands is bounded by the number format, not by the data.
    """
    d = value.cast("double")
    _, step, power = _step(value)
    code = F.when(
        F.abs(d) < F.lit(float("inf")), (power - _LOWEST + 1).cast("bigint") * F.lit(2**_CODE_BITS) + step
    ).otherwise(F.lit(_ENDLESS))
    return (
        F.when(d.isNull(), F.lit(_NULL_BAND))
        .when(F.isnan(d), F.lit(_NAN_BAND))
        .when(d > 0, code)
        .when(d < 0, -code)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def fine_band(value: Column) -> Column:
    """A bigint of 20 bits that never decreases as the value grows inside its magnitude band."""
    scaled, step, _ = _step(value)
    part = F.least(F.floor((scaled - step) * F.lit(float(2**_FINE_BITS))), F.lit(2**_FINE_BITS - 1).cast("bigint"))
    part = F.coalesce(part.cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(value.cast("double") < 0, -part).otherwise(part)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[f"_{name}"])
    return condition


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median"):
    """Median as double of the non-NULL values, for the whole frame or for each key.

    Pass 1 counts equal values, pass 2 finds the one or two bands that hold the middle ranks, pass 3
    the one or two fine bands of these, pass 4 orders the distinct values of those fine bands only.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_band": magnitude_band(F.col(value)), "_fine": fine_band(F.col(value))})
    )
    by_band = Window.partitionBy(*(keys or [F.lit(0)]))
    up_to = by_band.orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_middle = (F.col("_upto") > F.col("_lo")) & (F.col("_upto") - F.col("_n") <= F.col("_hi"))
    bands = (
        counts.groupBy(*keys, "_band")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(up_to))
        .withColumn("_rows", F.sum("_n").over(by_band))
        .withColumn("_lo", F.expr("(_rows - 1) div 2"))
        .withColumn("_hi", F.expr("_rows div 2"))
        .filter(in_middle)
    )
    inside = _only(counts, bands, keys, ["_band"], [*keys, value, "_n", "_band", "_fine"])
    ranks = ["_below", "_lo", "_hi"]
    fine_up_to = Window.partitionBy(*keys, "_band").orderBy("_fine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = (
        inside.groupBy(*keys, "_band", "_fine", *ranks)
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", F.col("_below") + F.sum("_n").over(fine_up_to))
        .filter(in_middle)
    )
    inside = _only(inside.drop(*ranks), fine, keys, ["_band", "_fine"], [*keys, value, "_n", "_band", "_fine"])
    in_band = (
        Window.partitionBy(*keys, "_band", "_fine")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.col("_below") + F.sum("_n").over(in_band)
    return (
        inside.withColumn("_upto", upto)
        .filter(in_middle)
        .groupBy(*keys)
        .agg(_between(F.min(value).cast("double"), F.max(value).cast("double")).alias(name))
    )


def _only(counts: DataFrame, middle: DataFrame, keys: list[str], parts: list[str], columns: list[str]) -> DataFrame:
    """The counts in the middle parts, with the number of rows below the part and both middle ranks."""
    chosen = middle.select(
        *[F.col(k).alias(f"_{k}") for k in [*keys, *parts]],
        (F.col("_upto") - F.col("_n")).alias("_below"),
        "_lo",
        "_hi",
    )
    if not keys:
        chosen = F.broadcast(chosen)  # at most two rows: the parts with the two middle ranks
    return counts.join(chosen, _same(counts, chosen, [*keys, *parts])).select(*[counts[c] for c in columns], "_below", "_lo", "_hi")


def _between(low: Column, high: Column) -> Column:
    """The mean of two numbers; a number itself if both are equal, however large it is."""
    return F.when(low == high, low).otherwise((low + high) / 2)


def global_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add RANK() by descending value, NULLs last, without a single-partition sort of the rows."""
    counts = (
        df.groupBy(value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_band", magnitude_band(F.col(value)))
    )
    above = Window.partitionBy(F.lit(0)).orderBy(F.col("_band").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    bands = (
        counts.groupBy("_band")
        .agg(F.sum("_n").alias("_n"))
        .select("_band", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    )
    in_band = (
        Window.partitionBy("_band")
        .orderBy(F.col(value).desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = counts.join(bands, "_band").select(
        F.col(value).alias("_value"),
        (F.lit(1) + F.col("_above") + F.coalesce(F.sum("_n").over(in_band), F.lit(0))).alias(name),
    )
    return df.join(ranks, df[value].eqNullSafe(ranks["_value"]), "left").drop("_value")
