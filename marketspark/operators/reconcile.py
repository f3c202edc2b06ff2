"""The same total computed two ways: from the answers, and from the exported tables on disk."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.plans.questions import ALL_CATEGORIES

TOLERANCE = 0.005
_MONEY = "decimal(38,2)"


def _total(column: str, condition: str = "true") -> Column:
    return F.coalesce(
        F.sum(F.when(F.expr(condition), F.col(column))).cast(_MONEY), F.lit(0).cast(_MONEY)
    )


def _rows(condition: str) -> Column:
    return F.count_if(F.expr(condition)).cast(_MONEY)


def _figures(df: DataFrame, side: str, figures: dict[str, tuple[Column, str]]) -> DataFrame:
    """One pass over one table; (metric, value, source) for each figure."""
    one = df.agg(*[value.alias(metric) for metric, (value, _) in figures.items()])
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(metric).alias("metric"),
                        F.col(metric).alias(f"{side}_value"),
                        F.lit(source).alias(f"{side}_source"),
                    )
                    for metric, (_, source) in figures.items()
                ]
            )
        )
    )


def reconcile(answers: Mapping[str, DataFrame], exported: Mapping[str, DataFrame]) -> DataFrame:
    """Seven totals with both values, compared as exact decimals; fails on fan-out or lost rows."""
    done = "is_delivered = 1"
    whole = f"category = '{ALL_CATEGORIES}'"
    from_answers = [
        (
            "monthly_orders_revenue",
            {
                "delivered_orders": (_total("orders_delivered"), "sum of orders_delivered"),
                "revenue": (_total("revenue_delivered"), "sum of revenue_delivered"),
            },
        ),
        (
            "freight_share",
            {
                "revenue_by_category": (_total("revenue", whole), "revenue of the total row"),
                "freight": (_total("freight", whole), "freight of the total row"),
            },
        ),
        ("late_delivery_by_state", {"late_orders": (_total("late_orders"), "sum of late_orders")}),
        (
            "repeat_customer_rate",
            {
                "customers": (_total("customers"), "customers"),
                "repeat_customers": (_total("repeat_customers"), "repeat_customers"),
            },
        ),
    ]
    from_exports = [
        (
            "fact_orders",
            {
                "delivered_orders": (_rows(done), "rows delivered"),
                "revenue": (_total("item_revenue", done), "item_revenue of delivered orders"),
                "freight": (_total("freight_value", done), "freight_value of delivered orders"),
                "late_orders": (_total("is_late"), "sum of is_late"),
            },
        ),
        (
            "fact_order_items",
            {"revenue_by_category": (_total("price", done), "price of delivered items")},
        ),
        (
            "dim_customer",
            {
                "customers": (_rows("delivered_orders >= 1"), "rows with a delivered order"),
                "repeat_customers": (_total("is_repeat_customer"), "sum of is_repeat_customer"),
            },
        ),
    ]

    def side(name: str, parts, tables: Mapping[str, DataFrame]) -> DataFrame:
        frames = [
            _figures(
                tables[table],
                name,
                {m: (value, f"{table}: {text}") for m, (value, text) in figures.items()},
            )
            for table, figures in parts
        ]
        return reduce(DataFrame.unionByName, frames)

    left, right = side("sql", from_answers, answers), side("export", from_exports, exported)
    return left.join(right, "metric").select(
        "metric",
        "sql_value",
        "sql_source",
        "export_value",
        "export_source",
        (F.abs(F.col("sql_value") - F.col("export_value")) < TOLERANCE).alias("matches"),
        F.col("sql_value").alias("expected_value"),
    )
