"""Answers worked out on paper for the hand-made shop (see fixture.py)."""

from __future__ import annotations

from dataclasses import replace

import pytest

from marketspark.params import SMALL_DATA
from marketspark.plans import questions
from tests.conftest import keyed, rows


def column(items, name):
    return [None if i[name] is None else float(i[name]) for i in items]


def test_monthly_orders_and_revenue(answers):
    months = answers["monthly_orders_revenue"]
    assert [m["orders_placed"] for m in months] == [3, 2, 2, 3, 1]
    assert [m["orders_delivered"] for m in months] == [3, 2, 2, 1, 0]
    assert [m["orders_cancelled"] for m in months] == [0, 0, 0, 1, 1]
    assert column(months, "revenue_delivered") == [470, 160, 230, 55, 0]
    assert column(months, "avg_order_value") == [156.67, 80, 115, 55, None]
    assert column(months, "revenue_mom_pct") == [None, -65.96, 43.75, -76.09, -100]
    assert sum(m["is_partial_month"] for m in months) == 0


def test_growth_is_empty_next_to_a_partial_month(spark):
    sizes = {"2020-01-01": 1, "2020-02-01": 30, "2020-03-01": 30, "2020-05-01": 40}
    data = [(m, 1, 0, 10) for m, n in sizes.items() for _ in range(n)]
    orders = spark.createDataFrame(
        data, "m string, is_delivered int, is_cancelled int, v int"
    ).selectExpr(
        "cast(m as date) purchase_month",
        "is_delivered",
        "is_cancelled",
        "cast(v as decimal(22,2)) item_revenue",
    )
    months = rows(questions.monthly_orders_revenue({"fact_orders": orders}, SMALL_DATA))
    assert [m["is_partial_month"] for m in months] == [1, 0, 0, 0]
    # February follows a partial month; May is compared with the row before it, March.
    assert column(months, "revenue_mom_pct") == [None, None, 0, 33.33]


def test_repeat_customers_are_people_and_same_day_is_not_a_return(answers):
    (row,) = answers["repeat_customer_rate"]
    assert (row["customers"], row["repeat_customers"]) == (5, 3)  # ann, bob and eve
    assert row["repeat_rate_pct"] == 60
    assert row["orders_per_customer"] == 1.6
    assert row["median_days_first_to_second_order"] == 21  # 0, 21, 30
    assert row["repeat_rate_pct_if_counted_by_customer_id"] == 0
    assert row["repeat_customers_same_day_only"] == 1  # bob
    assert row["customers_back_on_later_day"] == 2
    assert row["repeat_rate_pct_later_day"] == 40
    assert row["median_days_to_later_day_order"] == 25.5  # 21, 30


def test_top_categories(answers):
    found = keyed(answers["top_categories"], "category")
    assert [c["category"] for c in answers["top_categories"]] == [
        "unknown",
        "furniture",
        "beauty",
        "pet",
        "raro",
    ]
    assert float(found["furniture"]["revenue"]) == 270
    assert found["furniture"]["orders"] == 4
    assert (found["furniture"]["avg_review"], found["furniture"]["reviewed_orders"]) == (4.5, 2)
    assert found["unknown"]["revenue_share_pct"] == 35.53
    assert found["pet"]["orders"] == 1  # three units, one order
    assert found["raro"]["avg_review"] is None
    assert [c["review_rank"] for c in answers["top_categories"]] == [3, 1, 2, 4, 5]


def test_review_rank_only_for_categories_with_enough_orders(run):
    params = replace(SMALL_DATA, min_category_orders=3)
    found = keyed(rows(questions.top_categories(run.tables, params)), "category")
    ranks = {c: r["review_rank"] for c, r in found.items() if r["review_rank"]}
    assert ranks == {"furniture": 1, "beauty": 2}


def test_late_delivery_by_state(answers):
    states = answers["late_delivery_by_state"]
    assert [s["customer_state"] for s in states] == ["RJ", "PE", "RS", "SP"]
    rj = states[0]
    assert (rj["delivered_orders"], rj["late_orders"], rj["late_rate_pct"]) == (2, 2, 100)
    assert (rj["avg_delivery_days"], rj["avg_days_late_when_late"]) == (14, 5.5)
    assert sum(s["late_orders"] for s in states) == 3


def test_review_late_vs_on_time(answers):
    sides = keyed(answers["review_late_vs_on_time"], "delivery_group")
    assert [s["delivery_group"] for s in answers["review_late_vs_on_time"]] == ["on_time", "late"]
    assert (sides["on_time"]["orders_with_review"], sides["on_time"]["avg_review"]) == (3, 4)
    assert (sides["late"]["orders_with_review"], sides["late"]["avg_review"]) == (2, 1.5)
    assert sides["on_time"]["sd_review"] == 1
    assert sides["late"]["sd_review"] == 0.7071
    assert (sides["late"]["low_review_pct"], sides["on_time"]["low_review_pct"]) == (100, 0)
    assert sides["on_time"]["five_star_pct"] == 33.33
    assert sides["late"]["answered_before_delivery"] == 1  # o3
    assert sides["late"]["answered_after_delivery"] == 1
    assert sides["late"]["avg_review_answered_after_delivery"] == 1


def test_freight_share(answers):
    shares = keyed(answers["freight_share"], "category")
    total = answers["freight_share"][0]
    assert total["category"] == "ALL CATEGORIES"
    assert (float(total["revenue"]), float(total["freight"])) == (985, 118)
    assert (total["orders"], total["freight_share_pct"]) == (9, 11.98)
    assert shares["pet"]["freight_share_pct"] == 20
    assert [r["category"] for r in answers["freight_share"]][1:] == [
        "pet",
        "unknown",
        "furniture",
        "beauty",
        "raro",
    ]


def test_cohort_retention(answers):
    cells = {
        (str(r["cohort_month"]), r["months_since_first"]): r for r in answers["cohort_retention"]
    }
    assert len(cells) == 5
    assert cells["2020-01-01", 0]["cohort_size"] == 2  # ann and bob
    assert cells["2020-01-01", 1]["retention_pct"] == 50  # ann
    assert cells["2020-03-01", 1]["active_customers"] == 1  # eve
    assert cells["2020-02-01", 0]["retention_pct"] == 100


def test_seller_ranking(answers):
    sellers = keyed(answers["seller_ranking"], "seller_id")
    s1, s2 = sellers["s1"], sellers["s2"]
    assert (float(s1["revenue"]), s1["orders"], s1["revenue_rank"]) == (620, 6, 1)
    assert (float(s2["revenue"]), s2["orders"], s2["revenue_rank"]) == (365, 5, 2)
    assert (s1["late_rate_pct"], s2["late_rate_pct"]) == (50, 50)
    assert (s1["avg_review"], s2["avg_review"]) == (3.33, 3.5)
    assert (s1["seller_state"], s2["seller_state"]) == ("SP", "RJ")
    assert s1["worse_than_marketplace"] == 0  # not later than the marketplace


def test_sellers_with_few_orders_are_not_ranked(run):
    params = replace(SMALL_DATA, min_seller_orders=6)
    assert [r["seller_id"] for r in rows(questions.seller_ranking(run.tables, params))] == ["s1"]


def test_payment_types(answers):
    kinds = keyed(answers["payment_types"], "payment_type")
    assert set(kinds) == {"credit_card", "boleto", "voucher"}  # not_defined paid a cancelled order
    assert kinds["boleto"]["orders_using_type"] == 5
    assert kinds["boleto"]["pct_of_orders"] == 55.56
    assert float(kinds["credit_card"]["payment_value"]) == 539
    assert kinds["credit_card"]["avg_installments"] == 2.5
    assert sum(k["pct_of_orders"] for k in kinds.values()) > 100


def test_basket_size(answers):
    (row,) = answers["basket_size"]
    assert row["delivered_orders"] == 9
    assert row["avg_items_per_order"] == 1.444
    assert row["avg_distinct_products"] == 1.222
    assert row["avg_order_value"] == 109.44
    assert row["median_order_value"] == 100
    assert row["multi_item_order_pct"] == 33.33


def test_review_by_delay_bucket(answers):
    bands = answers["review_by_delay_bucket"]
    assert [(b["delay_bucket_order"], b["avg_review"]) for b in bands] == [(1, 4), (2, 2), (4, 1)]
    assert bands[1]["answered_before_delivery_pct"] == 100


def test_worst_routes(answers):
    routes = keyed(answers["worst_routes"], "route")
    assert routes["RJ -> PE"]["late_rate_pct"] == 100  # o7 counts on both of its routes
    assert routes["SP -> PE"]["late_rate_pct"] == 100
    assert routes["SP -> RS"]["orders"] == 2
    assert [r["late_rate_pct"] for r in answers["worst_routes"]][-1] == 0


def test_twelve_questions_with_a_text():
    assert len(questions.QUESTIONS) == 12
    assert all(q.text.endswith("?") for q in questions.QUESTIONS)


@pytest.mark.parametrize("parts", ["1", "64"])
def test_answers_do_not_depend_on_partitions(spark, run, answers, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for q in questions.QUESTIONS:
            assert rows(q.answer(run.tables, SMALL_DATA)) == answers[q.answer.__name__], q.name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
