"""An export of one table or one answer builds the tables that it needs, and no others."""

from __future__ import annotations

import pytest

from marketspark.plans import catalog
from marketspark.plans.warehouse import Warehouse
from marketspark.sources import binding

SF_DIR = "/root/testdata/sf0.001"
NEEDED = {
    "exported_dim_state": {"clean_state_centroids", "dim_state"},
    "exported_dim_seller": {"clean_sellers", "dim_seller"},
    "exported_dim_product": {"clean_products", "dim_product"},
}


@pytest.fixture
def built(spark, monkeypatch):
    """Name of a query -> (its rows, the tables that were stored for it)."""

    def run(name):
        t = Warehouse(spark, binding.raw_tables(spark, SF_DIR), binding.PARAMS, binding.states(spark, SF_DIR))
        monkeypatch.setattr(catalog, "warehouse_for", lambda *_: t)
        rows = catalog.QUERIES[name](spark, SF_DIR).collect()
        stored = {n for n in t._ready if n not in t._views}
        return rows, stored

    return run


@pytest.mark.parametrize("name", NEEDED)
def test_small_exports(built, name):
    rows, stored = built(name)
    assert rows and stored == NEEDED[name]


@pytest.mark.parametrize("name", ["exported_q10_basket_size", "exported_q09_payment_types", "exported_agg_worst_routes", "exported_fact_orders"])
def test_no_other_answers(built, name):
    _, stored = built(name)  # on these few rows no route has enough orders
    answers = stored & set(catalog.warehouse.ANSWERS)
    assert len(answers) == (name != "exported_fact_orders") and not stored & {"dim_customer", "dim_date", "clean_state_centroids"}


def test_lines_need_no_other_lines(built):
    """The fact of order lines is made without payments and sums per order."""
    rows, stored = built("export_privacy")
    assert rows and not stored & {"clean_payments", "fact_orders", "fact_payments"}
    rows, stored = built("payment_types")
    assert rows and not stored & {"clean_order_items", "fact_orders", "fact_order_items"}


def test_facts_of_lines_are_the_same_from_either_side(spark):
    def made(first):
        t = Warehouse(spark, binding.raw_tables(spark, SF_DIR), binding.PARAMS, binding.states(spark, SF_DIR))
        t.together(*first)
        facts = t["fact_order_items"], t["fact_payments"]
        assert t.ready("order_columns") != bool(first)
        return [sorted(map(repr, f.collect())) for f in facts]

    assert made(["fact_orders"]) == made([])


@pytest.mark.parametrize("name", ["exported_agg_cohort_retention", "worst_states_what_if", "review_by_delay_bucket"])
def test_questions_about_orders_alone(built, name):
    _, stored = built(name)
    assert "order_columns" in stored and not stored & {"fact_orders", "clean_order_items", "clean_payments"}
