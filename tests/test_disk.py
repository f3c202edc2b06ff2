"""What a run leaves on disk: lines are shuffled by order once, shuffles go when their query ends, exports follow one another."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from marketspark.functions.ordering import CROWD
from marketspark.operators import clean, model
from marketspark.plans.warehouse import Warehouse, lines_by_order
from marketspark.sources import binding, sinks, store

SF_DIR = "/root/testdata/sf0.001"
SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
LINE = "order_id string, order_item_id string, product_id string, seller_id string, shipping_limit_date string, price string, freight_value string"


def made(spark, lines=None):
    raw = binding.raw_tables(spark, SF_DIR)
    if lines is not None:
        raw["order_items"] = raw["order_items"].unionByName(lines)
    return Warehouse(spark, raw, binding.PARAMS, binding.states(spark, SF_DIR))


@pytest.fixture(scope="module")
def crowded(spark):
    """The small tables, with lines of an order that has very many, twice each, of no order, and of one that isn't there."""
    first = binding.raw_tables(spark, SF_DIR)["orders"].select("order_id").where("order_status = 'delivered'").first()[0]
    rows = [(first, str(i // 2), f"p{i % 40}", f"s{i % 7}", None, str(i), "1.00") for i in range(2 * CROWD + 10)]
    rows += [(None, str(i), None, None, None, "1", "1") for i in range(3)] + [("nowhere", "1", "p1", "s1", None, "x", "1")]
    return made(spark, spark.createDataFrame(rows, LINE))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_lines_of_crowded_orders_are_a_table_of_their_own(crowded):
    lines = crowded["clean_order_items"]
    assert crowded.seen["crowded_orders"]["rows"] == 1 and len(lines_by_order(crowded)) == 2
    assert rows(lines) == rows(clean.clean_order_items(crowded["raw_order_items"]))
    assert crowded["crowded_order_items"].count() >= CROWD and lines.where("order_id is null").count() == 3


def test_facts_from_both_tables_of_lines(crowded):
    t = crowded
    names = ("clean_orders", "clean_customers", "clean_order_items", "clean_payments", "clean_reviews")
    assert rows(t["fact_orders"]) == rows(model.fact_orders(*t.together(*names)))
    whole = model.fact_order_items(*t.together("clean_order_items", "fact_orders", "clean_products", "clean_sellers"))
    assert rows(t["fact_order_items"]) == rows(whole)


def test_calm_lines_meet_orders_where_they_lie(spark):
    """Before, lines were shuffled by order again for their fact, and twice for the sums of their order."""
    t = made(spark)
    before = {k: spark.conf.get(k) for k in SETTINGS}
    t.together("fact_orders", "clean_products", "clean_sellers", "calm_order_items")
    assert set(lines_by_order(t)) == {"calm_order_items"}  # no order is crowded
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        lines = model.lines_of_orders(t["calm_order_items"], t["fact_orders"])
        sums = model.items_per_order(t["calm_order_items"])
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (lines, sums)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plans[0].count("Exchange") == 1 and "Bucketed: true" in plans[0]  # that of the orders
    assert plans[1].count("Exchange") == 1 and plans[1].count("Bucketed: true") == 3  # folded lines


def test_shuffles_go_when_their_query_ends(spark):
    before = spark.conf.get(store.SHUFFLES_END, None)
    try:
        spark.conf.unset(store.SHUFFLES_END)
        store.Lake(spark, {})
        assert spark.conf.get(store.SHUFFLES_END) == "true"
        df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        assert rows(df) == rows(df)  # a frame can be read again
        spark.conf.set(store.SHUFFLES_END, "false")
        store.Lake(spark, {})
        assert spark.conf.get(store.SHUFFLES_END) == "false"  # what a session says holds
    finally:
        spark.conf.unset(store.SHUFFLES_END) if before is None else spark.conf.set(store.SHUFFLES_END, before)


def test_facts_are_gathered_by_month_once(spark, tmp_path):
    """Facts of lines where they are exported, that of orders where it is stored."""
    t = made(spark)
    t.model()
    by_month = {name for name in sinks.MONTH_PARTITIONED if glob.glob(f"{t.folder}/{name}/purchase_month=*".removeprefix("file:"))}
    assert by_month == {"fact_orders"} == set(store.STORED_BY_MONTH)
    for name in sinks.MONTH_PARTITIONED:
        again = sinks.export_table(t, {}, name, str(tmp_path), stored=True)
        assert rows(again) == rows(t[name].select(*again.columns))
        assert any(p.startswith("purchase_month=") for p in os.listdir(tmp_path / name))


def test_facts_are_exported_in_turn(spark):
    at_work, most = set(), []

    def write(name):
        at_work.add(name)
        most.append(len(at_work & set(sinks.MONTH_PARTITIONED)))
        at_work.discard(name)
        return name

    found = sinks.export_each(spark, write)
    assert list(found) == [*sinks.EXPORT_COLUMNS, *sinks.AGGREGATES] == list(found.values()) and max(most) == 1
