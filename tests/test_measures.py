from __future__ import annotations

import datetime

import pytest

from marketspark.operators import measures
from tests.conftest import keyed, rows


def one(run, name, **kw):
    (row,) = rows(measures.measure(run.tables, name, **kw))
    return row[name]


def test_totals_without_slicers(run):
    expected = {
        "orders_placed": 12,
        "delivered_orders": 9,
        "revenue": 985,
        "item_revenue": 985,
        "payment_value": 1073,
        "customers": 5,
        "repeat_customers": 3,
        "repeat_rate": 0.6,
        "orders_with_delivery_date": 6,
        "late_orders": 3,
        "late_rate": 0.5,
        "avg_delivery_days": 14,
        "average_order_value": 985 / 9,
        "freight_share": 118 / 985,
        "avg_review_score": 19 / 6,  # 5 4 2 1 4 3
        "low_review_share": 2 / 6,
        "answered_before_delivery_share": 1 / 5,
    }
    found = {name: float(one(run, name)) for name in expected}
    assert found == pytest.approx(expected)


def test_by_dimension_and_slicers(run):
    by_region = keyed(rows(measures.measure(run.tables, "revenue", ["dim_state.region"])), "region")
    assert float(by_region["Southeast"]["revenue"]) == 200 + 120 + 60 + 55
    assert float(by_region[None]["revenue"]) == 70  # o10 has no customer
    where = {"dim_date.month_number": [1], "dim_state.region": ["Southeast"]}
    assert float(one(run, "revenue", where=where)) == 320
    by_home = keyed(
        rows(measures.measure(run.tables, "delivered_orders", ["dim_customer.customer_state"])),
        "customer_state",
    )
    assert by_home["PE"]["delivered_orders"] == 2  # eve's second parcel went to SP


def test_lifetime_measures_ignore_date_slicers(run):
    assert one(run, "customers", where={"dim_date.year": [1999]}) == 5


def test_each_order_counts_once_in_a_category(run):
    by = ["fact_order_items.category"]
    scores = keyed(rows(measures.measure(run.tables, "avg_review_orders_in_category", by)), "category")
    assert scores["pet"]["avg_review_orders_in_category"] == 1
    assert scores["furniture"]["avg_review_orders_in_category"] == 4.5


def test_growth_follows_the_calendar(spark, run):
    growth = keyed(rows(measures.revenue_mom(run.tables)), "month_start")
    assert growth[datetime.date(2020, 1, 1)]["revenue_mom"] is None
    assert growth[datetime.date(2020, 2, 1)]["revenue_mom"] == pytest.approx(-310 / 470)
    # Without March, April has no previous month, although February is the row before it.
    march = "purchase_month <> date'2020-03-01'"
    gap = {
        "fact_orders": run.tables["fact_orders"].filter(march),
        "dim_date": run.tables["dim_date"],
    }
    growth = keyed(rows(measures.revenue_mom(gap)), "month_start")
    assert growth[datetime.date(2020, 4, 1)]["revenue_mom"] is None
    # A slicer on the shown month does not hide the month before.
    sliced = rows(measures.revenue_mom(run.tables, where={"dim_date.month_number": [2]}))
    assert [r["revenue_mom"] for r in sliced] == [pytest.approx(-310 / 470)]


def test_unrelated_attributes_are_an_error(run):
    with pytest.raises(ValueError):
        measures.measure(run.tables, "payment_value", ["dim_seller.seller_state"])
    with pytest.raises(ValueError):
        measures.measure(run.tables, "revenue", ["region"])
    with pytest.raises(ValueError):
        measures.measures(run.tables, ["revenue", "item_revenue"])


def test_page_queries(run):
    t = run.tables
    top = rows(measures.top_categories_by_item_revenue(t, 2))
    assert [r["category"] for r in top] == ["unknown", "furniture"]
    assert keyed(rows(measures.payment_mix(t)), "payment_type")["voucher"]["payment_value"] == 137
    matrix = rows(measures.cohort_matrix(t["cohort_retention"], 2))
    assert sorted(r["month_1"] for r in matrix) == [50, 50]
    counts = {r["delivered_orders"]: r["customers"] for r in rows(measures.orders_per_customer(t))}
    assert counts == {0: 2, 1: 2, 2: 3}
    delay = keyed(rows(measures.experience_by_delay(t)), "delay_bucket")
    assert delay["1-3 days late"]["answered_before_delivery_share"] == 1 and None not in delay
    assert [r["state_code"] for r in rows(measures.late_rate_by_state(t, 2)) if r["late_rate"]] == ["RJ"]
    days = keyed(rows(measures.revenue_by_weekday(t)), "weekday_name")
    assert float(days["Sun"]["revenue"]) == 150 + 150 + 55 and days["Sun"]["weekday_number"] == 7
    states = keyed(rows(measures.revenue_by_state(t, {"dim_date.year": [2020]})), "state_name")
    assert float(states["Bahia"]["revenue"]) == 80


def test_a_date_slicer_prunes_month_partitions(run):
    df = measures.measure(run.tables, "revenue", where={"dim_date.month_number": [1]})
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
    assert float(df.first()["revenue"]) == 470


def test_slicers_on_tables_that_are_not_there(run):
    with pytest.raises(ValueError, match="no table dim_stat"):
        measures.measure(run.tables, "revenue", where={"dim_stat.region": ["Southeast"]})
    whole = measures.measure(run.tables, "revenue").first()["revenue"]
    unrelated = measures.measure(run.tables, "revenue", where={"dim_product.category": ["toys"]}).first()["revenue"]
    assert unrelated == whole  # known, but orders have no relation to products


def test_growth_reads_the_fact_once_and_prunes_it(run):
    df = measures.revenue_mom(run.tables, where={"dim_date.month_number": [2]})
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "purchase_month" in line]
    assert len(scans) == 1 and all("dynamicpruning" in line for line in scans)
    assert [r["revenue_mom"] for r in df.collect()] == [pytest.approx(-310 / 470)]
