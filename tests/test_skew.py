"""One key holds a third of all rows: results stay right, and no task receives that third at once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketspark.functions.ordering import first_per_key
from marketspark.operators import clean, measures, model, quality
from marketspark.params import SMALL_DATA
from marketspark.plans import questions
from marketspark.sources.store import read_back, write_table

N = 90_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def sort_merge(spark):
    """No broadcast, and partitions count as skewed at test size: what a cluster would do."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Every third item belongs to order 0, product 0 and seller 0; every third order to nobody."""
    base = str(tmp_path_factory.mktemp("skew"))
    hot = "if(id % 3 = 0, '0', cast(id as string))"
    items = spark.range(0, N, 1, 24).selectExpr(
        f"{hot} order_id",
        "cast(id as int) order_item_id",
        "if(id % 3 = 0, '0', cast(id % 1000 as string)) product_id",
        "if(id % 3 = 0, '0', cast(id % 500 as string)) seller_id",
        "cast(null as timestamp_ntz) shipping_limit_ts",
        "cast(10 + id % 90 as decimal(12,2)) price",
        "cast(1 as decimal(12,2)) freight_value",
    )
    orders = spark.range(0, N, 1, 24).selectExpr(
        "cast(id as string) order_id",
        "if(id % 3 = 0, null, cast(id % 20000 as string)) customer_id",
        "'delivered' order_status",
        "timestamp_ntz'2020-01-01 10:00:00' + make_dt_interval(cast(id % 300 as int)) purchase_ts",
        "timestamp_ntz'2020-01-05 10:00:00' + make_dt_interval(cast(id % 310 as int)) delivered_ts",
        "timestamp_ntz'2020-01-09 00:00:00' + make_dt_interval(cast(id % 300 as int)) estimated_ts",
        "true is_delivered",
        "false is_cancelled",
        "true has_valid_delivery",
        "cast(4 as bigint) delivery_days",
        "cast(id % 20 - 10 as bigint) delay_days",
    )
    tables = {
        "items": items,
        "orders": orders,
        "customers": spark.range(20000).selectExpr(
            "cast(id as string) customer_id",
            "if(id % 3 = 0, 'guest', cast(id as string)) customer_unique_id",
            "cast(id % 27 as string) customer_state",
            "'c' customer_city",
        ),
        "products": spark.range(1000).selectExpr(
            "cast(id as string) product_id", "cast(id % 20 as string) category"
        ),
        "sellers": spark.range(500).selectExpr(
            "cast(id as string) seller_id", "cast(id % 27 as string) seller_state"
        ),
        "payments": spark.range(0, N, 1, 24).selectExpr(
            f"{hot} order_id",
            "cast(id as int) payment_sequential",
            "'card' payment_type",
            "1 payment_installments",
            "cast(10 as decimal(12,2)) payment_value",
        ),
        "reviews": spark.range(N).selectExpr(
            "cast(id as string) order_id",
            "cast(1 + id % 5 as int) review_score",
            "timestamp_ntz'2020-02-01 00:00:00' review_answered_ts",
        ),
    }
    stored = {}
    for name, df in tables.items():
        write_table(df, f"{base}/{name}")
        stored[name] = read_back(spark, f"{base}/{name}", df)
    facts = model.fact_orders(
        stored["orders"],
        stored["customers"],
        stored["items"],
        stored["payments"],
        stored["reviews"],
    )
    write_table(facts, f"{base}/fact_orders", "fact_orders")
    stored["fact_orders"] = read_back(spark, f"{base}/fact_orders", facts)
    return stored


def test_joins_on_a_hot_key_are_split(shop, sort_merge):
    items = model.fact_order_items(
        shop["items"], shop["fact_orders"], shop["products"], shop["sellers"]
    )
    assert items.count() == N
    assert "skew=true" in final_plan(items)
    payments = model.fact_payments(shop["payments"], shop["fact_orders"])
    assert payments.count() == N
    assert "skew=true" in final_plan(payments)


def test_orders_without_a_customer_are_split(shop, sort_merge):
    orders = model.fact_orders(
        shop["orders"], shop["customers"], shop["items"], shop["payments"], shop["reviews"]
    )
    assert "skew=true" in final_plan(orders)
    assert orders.filter("customer_unique_id is null").count() == N // 3
    hot = orders.filter("order_id = '0'").first()
    assert hot["items_count"] == N // 3 and float(hot["payment_value"]) == 10 * (N // 3)


def test_first_row_is_taken_before_the_shuffle(shop):
    one = first_per_key(shop["items"], ["order_id"], "order_item_id")
    assert one.count() == 1 + N - N // 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below


def test_questions_with_a_hot_person_and_a_hot_order(spark, shop):
    items = model.fact_order_items(
        shop["items"], shop["fact_orders"], shop["products"], shop["sellers"]
    )
    tables = {
        "fact_orders": shop["fact_orders"],
        "fact_order_items": items,
        "dim_seller": shop["sellers"],
    }
    (row,) = questions.repeat_customer_rate(tables, SMALL_DATA).collect()
    people = shop["fact_orders"].filter("customer_unique_id is not null")
    assert row["customers"] == people.select("customer_unique_id").distinct().count()
    (basket,) = questions.basket_size(tables, SMALL_DATA).collect()
    exact = shop["fact_orders"].agg(F.median("item_revenue")).first()[0]
    assert basket["median_order_value"] == exact
    ranked = questions.seller_ranking(tables, SMALL_DATA).collect()
    by_window = items.groupBy("seller_id").agg(F.sum("price").alias("p")).collect()
    sums = [r["p"] for r in by_window]
    assert {r["seller_id"]: r["revenue_rank"] for r in ranked} == {
        r["seller_id"]: 1 + sum(s > r["p"] for s in sums) for r in by_window
    }


def test_quality_lookups_fold_the_hot_key_first(spark, shop):
    tables = {
        "clean_orders": shop["orders"],
        "clean_customers": shop["customers"],
        "clean_order_items": shop["items"],
    }
    log = quality.quality_log(tables, ["orders_customer_not_found", "items_order_not_found"])
    assert {r["check"]: r["rows_affected"] for r in log.collect()} == {
        "orders_customer_not_found": N // 3,
        "items_order_not_found": 0,
    }


def test_centroid_of_one_crowded_state(spark):
    raw = spark.range(0, 60_000).selectExpr(
        "if(id % 3 = 0, 'SP', cast(id % 20 as string)) geolocation_state",
        "cast(if(id % 2 = 0, -23.5, -20 - (id % 997) / 200) as string) geolocation_lat",
        "cast(-40 - (id % 991) / 100 as string) geolocation_lng",
    )
    found = {r["state_code"]: r for r in clean.clean_state_centroids(raw).collect()}
    inside = raw.selectExpr("geolocation_state s", "double(geolocation_lat) a", "double(geolocation_lng) b")
    for s, lat, lng in inside.groupBy("s").agg(F.median("a"), F.median("b")).collect():
        assert (found[s]["latitude"], found[s]["longitude"]) == (round(lat, 4), round(lng, 4))


def test_measures_join_sums_not_facts(spark, shop):
    dates = model.dim_date(shop["fact_orders"])
    tables = {"fact_orders": shop["fact_orders"], "dim_date": dates}
    df = measures.measure(tables, "delivered_orders", ["dim_date.month_number"])
    assert sum(r["delivered_orders"] for r in df.collect()) == N
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join ")
    assert "Aggregate [purchase_date" in plan[join:]
