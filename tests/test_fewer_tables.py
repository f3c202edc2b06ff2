"""Queries read only the tables and columns that they need, and lines are sorted after the shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketspark.functions.ordering import crowds, distinct_rows, first_per_key, first_per_key_by, marks_of_copies
from marketspark.operators import clean, model, quality
from tests.test_single_exports import built  # noqa: F401

LINES = {"clean_order_items", "clean_payments", "fact_orders", "fact_order_items", "fact_payments"}
#: Query -> tables that it must not build.
NOT_NEEDED = {
    "last_full_month": LINES | {"clean_customers", "clean_reviews", "order_columns", "monthly_orders_revenue"},
    "exported_q10_basket_size": {"fact_orders", "clean_payments", "clean_customers", "clean_reviews"},
    "view_revenue_by_state": {"fact_orders", "clean_payments", "clean_reviews", "clean_state_centroids"},
    "memo_facts": {"fact_orders", "fact_order_items", "clean_payments", "dq_log", "seller_stats", "worst_routes", "basket_size"},
    "exported_fact_orders": {"order_columns", "fact_order_items", "clean_products"},
}


@pytest.mark.parametrize("name", NOT_NEEDED)
def test_tables_that_are_not_needed(built, name):  # noqa: F811
    rows, stored = built(name)
    assert rows and not stored & NOT_NEEDED[name]


@pytest.fixture(scope="module")
def lines(spark):
    """Order 0 has a third of the lines; each line number comes twice, with other products."""
    return spark.range(0, 9000, 1, 6).selectExpr(
        "if(id % 3 = 0, '0', if(id % 7 = 0, null, cast(id div 6 as string))) order_id",
        "cast(id % 4 as string) order_item_id",
        "if(id % 5 = 0, null, cast(id % 11 as string)) product_id",
        "cast(id % 2 as string) seller_id",
        "cast(null as string) shipping_limit_date",
        "cast(10 + id % 90 as string) price",
        "'1.00' freight_value",
    )


def test_first_rows_with_a_crowded_order(lines):
    keys = ["order_id", "order_item_id"]
    crowded = crowds(lines, "order_id")
    assert crowded.collect() == lines.limit(1).select(F.xxhash64(F.lit("0"))).collect()
    want = sorted(map(repr, first_per_key(lines, keys, "product_id").collect()))
    for most in (1, 1024, 10**6):
        got = first_per_key_by(lines, "order_id", keys, "product_id", crowded=crowds(lines, "order_id", most))
        assert sorted(map(repr, got.collect())) == want


def test_calm_lines_are_not_sorted_before_the_shuffle(lines):
    plan = clean.clean_order_items(lines, crowds(lines, "order_id"))._jdf.queryExecution().executedPlan().toString()
    calm, crowded = plan.split("Union")[1].split("LeftAnti", 1)
    above, _, below = calm.partition("REPARTITION_BY_COL")
    assert "WindowGroupLimit" in above and below and "WindowGroupLimit" not in below
    assert "WindowGroupLimit" in crowded.split("Exchange hashpartitioning(order_id", 1)[1].split("LeftSemi")[0]


def test_sums_of_an_order_with_repeated_products(lines):
    items = clean.clean_order_items(lines).unionByName(clean.clean_order_items(lines))
    want = items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items_count"),
        F.count_distinct("product_id").alias("distinct_products"),
        F.count_distinct("seller_id").alias("sellers_count"),
        F.sum("price").alias("item_revenue"),
        F.sum("freight_value").alias("freight_value"),
    )
    got = model.items_per_order(items)
    assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert model.items_per_order(items, ["product_id"]).columns == [c for c in want.columns if c != "sellers_count"]


def test_distinct_rows_with_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None), (None, None), ("a", "b")], "x string, y string")
    assert sorted(map(repr, distinct_rows(df, marks_of_copies(df)).collect())) == sorted(map(repr, df.distinct().collect()))


def test_checks_of_single_rows_read_no_lookup(spark):
    none = "cast(null as timestamp_ntz)"
    orders = spark.sql(
        f"select 'a' order_id, true is_cancelled, false is_delivered, {none} delivered_ts, {none} purchase_ts,"
        f" {none} estimated_ts, false has_valid_delivery, cast(null as bigint) delay_days"
    )
    (line,) = quality.quality_log({"clean_orders": orders}, ["orders_cancelled_or_unavailable"]).collect()
    assert (line["rows_affected"], line["table_rows"]) == (1, 1)
