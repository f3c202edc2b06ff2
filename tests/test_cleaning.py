from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marketspark.functions import columns as c
from marketspark.functions.ordering import first_per_key
from marketspark.operators import clean, quality
from tests.conftest import keyed, rows


def cast_all(spark, texts, function):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(function(F.col("t"))).collect()]


def test_numbers_round_and_bad_text_is_null(spark):
    texts = ["3", " 4 ", "2.7", "2.5", "-2.5", "1e2", "", "x", None, "99999999999", "1d", "0x10"]
    assert cast_all(spark, texts, c.try_int) == [
        3, 4, 3, 3, -3, 100, None, None, None, None, None, None,
    ]
    assert cast_all(spark, ["1.5", "heavy", "1f", "-.5"], c.try_double) == [1.5, None, None, -0.5]
    money = cast_all(spark, ["10", "10.005", "x", "99999999999.99"], c.try_money)
    assert [None if m is None else str(m) for m in money] == ["10.00", "10.01", None, None]


def test_timestamps_need_a_day_and_minutes(spark):
    texts = ["2017-01-05 10:00:00", "2017/1/5 10:00", "2017-01-05", "2017", "2017-01", "2017-13-01"]
    found = cast_all(spark, [*texts, "2017-01-05 10", "soon", None], c.try_timestamp)
    stamp = datetime.datetime(2017, 1, 5, 10)
    assert found == [stamp, stamp, datetime.datetime(2017, 1, 5), *[None] * 6]


def test_text_helpers(spark):
    assert cast_all(spark, [" a ", " ", "", None], c.blank_to_null) == ["a", None, None, None]
    assert cast_all(spark, [" 1310", "01310", "123456", "7"], c.pad_zip) == [
        "01310", "01310", "12345", "00007",
    ]


def test_months_count_boundaries_and_ratios_survive_zero(spark):
    df = spark.sql("select date'2020-01-31' a, date'2020-02-01' b, 0 z, 1 n")
    (row,) = df.select(
        (c.month_index(F.col("b")) - c.month_index(F.col("a"))).alias("months"),
        c.pct(F.col("n"), F.col("z")).alias("p"),
        c.ratio(F.col("n"), F.col("z")).alias("r"),
    ).collect()
    assert (row["months"], row["p"], row["r"]) == (1, None, None)


def test_rounding_follows_the_stored_value(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (-2.5,), (None,)], "v double")
    assert [r[0] for r in df.select(c.rounded(F.col("v"), 2)).collect()] == [1.0, 2.5, -2.5, None]
    assert [r[0] for r in df.select(c.rounded(F.col("v"), 0)).collect()] == [1, 3, -3, None]


def test_numbers_as_text_round_half_even(spark):
    df = spark.createDataFrame([(0.25,), (2.5,), (1234567.5,)], "v double")
    made = [tuple(r) for r in df.select(c.text_pct(F.col("v")), c.text_int(F.col("v"))).collect()]
    assert made == [("0.2%", "0"), ("2.5%", "2"), ("1234567.5%", "1,234,568")]


def test_first_per_key_ignores_row_order_and_is_idempotent(spark):
    data = [(k, random.randrange(3), random.choice("abc")) for k in range(20) for _ in range(5)]
    schema = "k int, v int, t string"
    first = first_per_key(spark.createDataFrame(data, schema), ["k"], "v desc")
    shuffled = random.sample(data, len(data))
    other = first_per_key(spark.createDataFrame(shuffled, schema).repartition(7), ["k"], "v desc")
    assert sorted(first.collect()) == sorted(other.collect())
    assert sorted(first_per_key(first, ["k"], "v desc").collect()) == sorted(first.collect())


def test_orders_are_typed_and_flagged(run):
    orders = keyed(rows(run.tables["clean_orders"]), "order_id")
    assert len(orders) == 12
    assert orders["o1"]["order_status"] == "delivered"
    assert orders["o2"]["delay_days"] == 0 and orders["o2"]["delivered_ts"].hour == 18
    assert not orders["o5"]["has_valid_delivery"] and orders["o5"]["is_delivered"]
    assert not orders["o6"]["has_valid_delivery"]
    assert orders["o7"]["purchase_ts"] == datetime.datetime(2020, 3, 15, 10)
    assert not orders["o9"]["is_delivered"] and orders["o9"]["is_cancelled"]
    assert orders["o10"]["purchase_ts"] is None  # a bare year is no date
    assert orders["o12"]["is_cancelled"]


def test_items_reviews_payments(run):
    items = {(r["order_id"], r["order_item_id"]): r for r in rows(run.tables["clean_order_items"])}
    assert len(items) == 15
    assert items["o11", 1]["product_id"] == "p2"  # first of the two by product
    assert items["o7", 1]["price"] is None
    reviews = keyed(rows(run.tables["clean_reviews"]), "order_id")
    assert (reviews["o4"]["review_id"], reviews["o4"]["review_score"]) == ("r4", 1)
    assert reviews["o7"]["review_score"] is None and reviews["o11"]["review_score"] == 3
    assert "review_comment_message" not in reviews["o2"]
    payments = rows(run.tables["clean_payments"])
    assert len([p for p in payments if p["order_id"] == "o11"]) == 1
    assert {p["payment_type"] for p in payments if p["order_id"] == "o2"} == {"boleto"}


def test_a_bad_latest_score_hides_an_older_good_one(spark):
    raw = spark.createDataFrame(
        [
            ("r1", "o1", "5", "2020-01-01 00:00:00", "2020-01-01 00:00:00"),
            ("r2", "o1", "8", "2020-01-02 00:00:00", "2020-01-02 00:00:00"),
            ("r3", "o2", "4", "2020-01-02 00:00:00", None),
            ("r4", "o2", "2", "2020-01-01 00:00:00", "2020-01-01 00:00:00"),
        ],
        "review_id string, order_id string, review_score string, review_creation_date string,"
        " review_answer_timestamp string",
    )
    found = keyed(rows(clean.clean_reviews(raw)), "order_id")
    assert (found["o1"]["review_id"], found["o1"]["review_score"]) == ("r2", None)
    assert found["o2"]["review_id"] == "r4"  # unanswered reviews come last


def test_products_and_categories(run):
    products = keyed(rows(run.tables["clean_products"]), "product_id")
    assert products["p1"]["category"] == "furniture"  # the smaller of two translations
    assert products["p3"]["category"] == products["p3"]["category_pt"] == "unknown"
    assert products["p4"]["category"] == "pet" and products["p4"]["has_english_name"]
    assert products["p5"]["category"] == "raro" and not products["p5"]["has_english_name"]
    assert (products["p1"]["photos_qty"], products["p1"]["description_length"]) == (3, 100)
    assert products["p2"]["weight_g"] is None and products["p5"]["width_cm"] is None


def test_customers_sellers_centroids(run):
    customers = keyed(rows(run.tables["clean_customers"]), "customer_id")
    assert customers["k1"]["customer_zip_code_prefix"] == "01234"
    assert (customers["k1"]["customer_city"], customers["k1"]["customer_state"]) == (
        "porto alegre",
        "RS",
    )
    assert customers["k12"]["customer_unique_id"] == "gil"
    sellers = keyed(rows(run.tables["clean_sellers"]), "seller_id")
    assert sellers["s2"]["seller_zip_code_prefix"] == "04001" and sellers["s1"]["seller_state"] == "SP"
    points = keyed(rows(run.tables["clean_state_centroids"]), "state_code")
    assert (points["RS"]["latitude"], points["RS"]["longitude"]) == (-30, -51)
    assert (points["SP"]["latitude"], points["SP"]["longitude"]) == (-23.45, -46.7)


EXPECTED = {name: 1 for name in quality.CHECK_NAMES} | {
    "orders_cancelled_or_unavailable": 2,
    "delivered_orders_without_items": 0,
    "delivered_orders_without_review": 3,
}


def test_quality_log(run):
    log = keyed(rows(run.dq_log), "check")
    assert len(log) == 27
    assert {name: line["rows_affected"] for name, line in log.items()} == EXPECTED
    assert log["orders_duplicate_order_id"]["table_rows"] == 13
    assert log["orders_duplicate_order_id"]["pct_of_table"] == 7.692
    assert log["geolocation_points_outside_brazil"]["table_rows"] == 7


@pytest.mark.parametrize("name", ["orders_customer_not_found", "items_duplicate_order_item_key"])
def test_one_check_alone(run, name):
    (line,) = rows(quality.quality_log(run.tables, [name]))
    assert line["rows_affected"] == EXPECTED[name]


def test_unknown_check_is_an_error(run):
    with pytest.raises(ValueError):
        quality.quality_log(run.tables, ["nope"])


def test_an_empty_table_gives_zero_percent(spark, run):
    empty = {"clean_payments": run.tables["clean_payments"].limit(0)}
    (line,) = rows(quality.quality_log(empty, ["payments_zero_value"]))
    assert (line["rows_affected"], line["table_rows"], line["pct_of_table"]) == (0, 0, 0)


def test_copies_are_told_apart_from_rows_that_look_alike(spark, monkeypatch):
    """With digests that are all equal every row is compared whole; NULLs in other columns are other rows."""
    from pyspark.sql import functions as F

    from marketspark.operators import quality

    rows = [("a", None, "1"), (None, "a", "1"), ("a", None, "1"), ("b", "c", "2"), ("b", "c", "3"), ("b", "c", "2"), (None, None, None)]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    counted = lambda: sorted((r["x"] or "", r["_copies"]) for r in quality._copies(df, "x").collect())
    expected = [("", 1), ("", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert counted() == expected
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert counted() == expected
