"""Exact medians and ranks against brute force, with hot values and hot groups."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from marketspark.functions import ordering
from marketspark.functions.ordering import exact_median, global_rank, magnitude_band

random.seed(7)
SAMPLES = {
    "odd": [3, 1, 2],
    "even": [4, 1, 2, 3],
    "one": [5],
    "hot": [7.25] * 400 + [random.uniform(-10, 10) for _ in range(200)],
    "halves": [1] * 50 + [1000000] * 50,
    "signs": [random.choice([-1, 1]) * 10 ** random.uniform(-9, 9) for _ in range(501)] + [0, 0],
}


@pytest.mark.parametrize("name", SAMPLES)
def test_median(spark, name):
    values = [float(v) for v in SAMPLES[name]]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
    assert exact_median(df, "v").first()[0] == statistics.median(values)


def test_median_by_group_with_a_null_group_and_none_for_nothing(spark):
    groups = {name: [float(v) for v in values] for name, values in SAMPLES.items()}
    groups[None] = [2.0, 9.0]
    data = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    found = {r["g"]: r["median"] for r in exact_median(df, "v", ["g"]).collect()}
    assert found == {g: statistics.median(values) for g, values in groups.items()}
    assert exact_median(df.filter("v is null"), "v").first()[0] is None


def test_median_of_money(spark):
    df = spark.sql("select cast(id as decimal(12,2)) / 4 v from range(1, 101)").selectExpr(
        "cast(v as decimal(12,2)) v"
    )
    values = sorted(float(r[0]) for r in df.collect())
    assert exact_median(df, "v").first()[0] == statistics.median(values)


INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize(
    ("values", "wanted"),
    [
        ([1.0, NAN, 2.0], 2.0),  # Spark sorts NaN above everything
        ([1.0, INF, 2.0], 2.0),
        ([-INF, INF, 5.0], 5.0),
        ([-INF, -INF, 1.0], -INF),
        ([1.0, INF], INF),
        ([INF, INF, 1.7e308, NAN], INF),
        ([1.6e308, 1.7e308, 1.5e308], 1.6e308),
        ([5e-324, 1e-300, -5e-324], 5e-324),
    ],
)
def test_median_at_the_ends_of_the_number_line(spark, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_median(df, "v").first()[0] == wanted


def test_median_among_nans(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, NAN, NAN)], "v double")
    found = exact_median(df, "v").first()[0]
    assert found != found


def test_bands_never_decrease(spark):
    ends = {1e300, 1e-300, 2**40, 1.7e308, 5e-324, INF, -INF, -1.7e308}
    values = sorted(float(v) for v in {*SAMPLES["signs"], *SAMPLES["hot"], *ends})
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    bands = [r[0] for r in df.select(magnitude_band(F.col("v"))).collect()]
    assert bands == sorted(bands)
    assert len(set(bands)) > len(values) / 3


def test_rank_with_ties_and_nulls(spark):
    values = [random.choice([10, 20, 30, 12345, None]) for _ in range(300)] + list(range(1000, 1200))
    df = spark.createDataFrame(list(enumerate(values)), "id int, v bigint").repartition(4)
    known = [v for v in values if v is not None]
    expected = {
        i: 1 + (len(known) if v is None else sum(k > v for k in known))
        for i, v in enumerate(values)
    }
    found = {r["id"]: r["r"] for r in global_rank(df, "v", "r").collect()}
    assert found == expected


def test_a_crowded_band_is_cut_before_it_is_ordered(spark):
    """Doubles that differ in their last bits only: one band, many fine bands, each with a few values."""
    rows = spark.range(40_000).selectExpr("1000.0D + id * 1e-9 AS v", "if(id % 2 = 0, 'a', 'b') AS k", "id")
    bands = rows.select(ordering.magnitude_band(F.col("v")).alias("b"), ordering.fine_band(F.col("v")).alias("f"), "v")
    assert bands.select("b").distinct().count() == 1
    sizes = bands.groupBy("f").agg(F.count_distinct("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("f").collect()
    assert len(sizes) > 100 and max(r["n"] for r in sizes) < 1000
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    values = sorted(r["v"] for r in rows.collect())
    assert ordering.exact_median(rows, "v").first()[0] == (values[19_999] + values[20_000]) / 2
    got = {r["k"]: r["median"] for r in ordering.exact_median(rows, "v", ["k"]).collect()}
    for k, odd in (("a", 0), ("b", 1)):
        own = sorted(r["v"] for r in rows.where(f"id % 2 = {odd}").collect())
        assert got[k] == (own[9_999] + own[10_000]) / 2


@pytest.mark.parametrize("sign", [1, -1])
def test_fine_bands_never_fall(spark, sign):
    values = [sign * v for v in (0.0, 5e-324, 1e-300, 2**-60, 2**-41, 1.5, 1.5 + 2**-40, 2.0, 1e15, 1e300, 1.7e308, float("inf"))]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordering.magnitude_band(F.col("v")), ordering.fine_band(F.col("v")))
    codes = [tuple(r)[1:] for r in df.orderBy("v").collect()]
    assert codes == sorted(codes) and all(abs(f) < 2**20 for _, f in codes)
