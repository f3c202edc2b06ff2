"""Queries a dashboard asks of the stored answers: pick, filter, sort, limit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Answers = Mapping[str, DataFrame]

TREND_METRICS = ("revenue_delivered", "orders_delivered", "orders_placed", "avg_order_value")
CATEGORY_ORDERS = {
    "revenue": F.desc_nulls_last,
    "highest_review": F.desc_nulls_last,
    "lowest_review": F.asc_nulls_last,
}


def monthly_trend(answers: Answers, metric: str, hide_partial: bool = True) -> DataFrame:
    if metric not in TREND_METRICS:
        raise ValueError(f"metric must be one of {TREND_METRICS}")
    months = answers["monthly_orders_revenue"]
    if hide_partial:
        months = months.filter("is_partial_month = 0")
    return months.select(
        F.col("purchase_month").alias("month"), F.col(metric).alias("value")
    ).orderBy("month")


def category_ranking(
    answers: Answers, top_n: int, rank_by: str = "revenue", reliable_only: bool = True
) -> DataFrame:
    if rank_by not in CATEGORY_ORDERS:
        raise ValueError(f"rank_by must be one of {tuple(CATEGORY_ORDERS)}")
    rows = answers["top_categories"]
    if reliable_only:
        rows = rows.filter("enough_orders = 1")
    column = "revenue" if rank_by == "revenue" else "avg_review"
    return (
        rows.select(
            "category", "orders", "revenue", "revenue_share_pct", "avg_review", "reviewed_orders"
        )
        .orderBy(CATEGORY_ORDERS[rank_by](column), "category")
        .limit(top_n)
    )


def late_by_state_filtered(answers: Answers, min_orders: int) -> DataFrame:
    return (
        answers["late_delivery_by_state"]
        .filter(F.col("delivered_orders") >= min_orders)
        .orderBy(F.desc_nulls_last("late_rate_pct"), F.asc_nulls_last("customer_state"))
    )


def retention_curve(answers: Answers, months_since_first: int) -> DataFrame:
    return (
        answers["cohort_retention"]
        .filter(F.col("months_since_first") == months_since_first)
        .select(
            F.col("cohort_month").alias("cohort"),
            "retention_pct",
            "cohort_size",
            "active_customers",
        )
        .orderBy("cohort")
    )
