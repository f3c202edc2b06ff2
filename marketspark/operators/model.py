"""Typed tables to a star schema: three facts that share five dimensions.

Child tables are aggregated to one row per order before they are joined, so no join multiplies
rows and every join below has a unique key on its lookup side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.functions.columns import flag, month_start
from marketspark.operators.clean import UNKNOWN

# Upper limit in days of each delay band, with its label; later days fall in the last.
DELAY_BANDS = ((0, "On time or early"), (3, "1-3 days late"), (7, "4-7 days late"), (14, "8-14 days late"))
LAST_DELAY_BAND = "15+ days late"

# The 27 states of Brazil with their region.
BRAZIL_STATES = (
    ("AC", "Acre", "North"),
    ("AL", "Alagoas", "Northeast"),
    ("AM", "Amazonas", "North"),
    ("AP", "Amapá", "North"),
    ("BA", "Bahia", "Northeast"),
    ("CE", "Ceará", "Northeast"),
    ("DF", "Distrito Federal", "Central-West"),
    ("ES", "Espírito Santo", "Southeast"),
    ("GO", "Goiás", "Central-West"),
    ("MA", "Maranhão", "Northeast"),
    ("MG", "Minas Gerais", "Southeast"),
    ("MS", "Mato Grosso do Sul", "Central-West"),
    ("MT", "Mato Grosso", "Central-West"),
    ("PA", "Pará", "North"),
    ("PB", "Paraíba", "Northeast"),
    ("PE", "Pernambuco", "Northeast"),
    ("PI", "Piauí", "Northeast"),
    ("PR", "Paraná", "South"),
    ("RJ", "Rio de Janeiro", "Southeast"),
    ("RN", "Rio Grande do Norte", "Northeast"),
    ("RO", "Rondônia", "North"),
    ("RR", "Roraima", "North"),
    ("RS", "Rio Grande do Sul", "South"),
    ("SC", "Santa Catarina", "South"),
    ("SE", "Sergipe", "Northeast"),
    ("SP", "São Paulo", "Southeast"),
    ("TO", "Tocantins", "North"),
)


def items_per_order(items: DataFrame, distinct: Sequence[str] = ("product_id", "seller_id")) -> DataFrame:
    """Size, variety, revenue and freight of each order.

    Lines fold to their order before they are shuffled. Different products (or sellers) are the lines that name one, less
    those beyond the first of each (order, product): only pairs that are found twice count against the order. No line is
    copied, and an order with very many lines is spread over its products and sellers. `distinct` says which of the two
    are counted; the columns of the others are left out.
    """
    counts = {column: f"{column.removesuffix('_id')}s" for column in distinct}
    named = {"product_id": "distinct_products", "seller_id": "sellers_count"}
    number = lambda c: c.cast("bigint")
    folded = items.select(
        "order_id",
        number(F.lit(1)).alias("lines"),
        *[number(F.when(F.col(c).isNotNull(), 1).otherwise(0)).alias(n) for c, n in counts.items()],
        "price",
        "freight_value",
    )
    for column in counts:
        pairs = items.filter(F.col(column).isNotNull()).groupBy("order_id", column).agg(F.count(F.lit(1)).alias("_n"))
        surplus = {"lines": F.lit(0), counts[column]: 1 - F.col("_n")}
        beyond = pairs.filter("_n > 1").select(
            "order_id",
            *[surplus.get(name, F.lit(None) if name in ("price", "freight_value") else F.lit(0)).cast(kind).alias(name)
              for name, kind in folded.dtypes[1:]],
        )
        folded = folded.unionByName(beyond)
    return folded.groupBy("order_id").agg(
        F.sum("lines").alias("items_count"),
        *[F.sum(n).alias(named[c]) for c, n in counts.items()],
        F.sum("price").alias("item_revenue"),
        F.sum("freight_value").alias("freight_value"),
    )


def payment_kinds(payments: DataFrame) -> DataFrame:
    """(payment_type, _number): the different types, numbered by name."""
    numbered = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("payment_type")).alias("_number")
    named = payments.select("payment_type").where(F.col("payment_type").isNotNull()).distinct()
    return named.select("payment_type", numbered)


def payments_per_order(payments: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Total paid and the type of the largest payment line (earliest line, then name, on a tie).

    The different types are numbered by name, so the first line of an order is the smallest of whole numbers made of
    value, sequence and that number. Sum and minimum then have a fixed width and are hashed, not sorted; the text of
    the type is looked up by its number afterwards. `kinds` are the numbered types, stored: Spark then knows before it
    starts how few they are, and no line is shuffled for its type.
    """
    value, kind = F.col("payment_value"), F.col("payment_type")
    kinds = payment_kinds(payments) if kinds is None else kinds
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    below = whole(F.lit(10**13), 14) - whole(value * 100, 14)  # larger values first
    sequence = F.coalesce(F.col("payment_sequential"), F.lit(2**31 - 1)).cast("bigint") + 2**31
    place = (below * whole(F.lit(2**32), 10) + whole(sequence, 10)) * whole(F.lit(2**31), 10) + whole(F.col("_number"), 10)
    numbers = kinds.select(F.col("payment_type").alias("_type"), "_number")
    lines = payments.join(numbers, kind == F.col("_type"), "left")
    best = lines.groupBy("order_id").agg(
        F.sum(value).alias("payment_value"), F.min(F.when(value.isNotNull(), place)).alias("_place")
    )
    winner = kinds.select(F.col("payment_type").alias("main_payment_type"), whole(F.col("_number"), 38).alias("_winner"))
    return best.join(winner, F.col("_place") % whole(F.lit(2**31), 38) == F.col("_winner"), "left").select(
        "order_id", "payment_value", "main_payment_type"
    )


def is_late(valid: Column, delay_days: Column) -> Column:
    """1 late, 0 on time or early, NULL when it cannot be told."""
    return F.when(valid, flag(delay_days > 0))


def delay_band(valid: Column, delay_days: Column, bands=DELAY_BANDS, last=LAST_DELAY_BAND):
    """(label, sort key) of the delay; both NULL when the delivery is not usable."""
    label = position = None
    for i, (limit, text) in enumerate(bands, start=1):
        hit = valid & (delay_days <= limit)
        label = F.when(hit, text) if label is None else label.when(hit, text)
        position = F.when(hit, i) if position is None else position.when(hit, i)
    return label.when(valid, last), position.when(valid, len(bands) + 1)


def answered_before_delivery(valid: Column, answered: Column, delivered: Column) -> Column:
    return F.when(valid & answered.isNotNull(), flag(answered < delivered))


#: Part of the fact of orders -> its columns that come from this table; the others come from the orders alone.
ORDER_PARTS = {
    "customers": ("customer_unique_id", "customer_state", "customer_city"),
    "items": ("items_count", "distinct_products", "sellers_count", "item_revenue", "freight_value"),
    "payments": ("payment_value", "main_payment_type"),
    "reviews": ("review_score", "review_answered_before_delivery"),
}


def _order_columns() -> dict[str, Column]:
    """The columns of the fact of orders, in order."""
    valid = F.col("has_valid_delivery")
    band, band_order = delay_band(valid, F.col("delay_days"))
    no_money = F.lit(0).cast("decimal(22,2)")
    return {
        "order_id": F.col("order_id"),
        "customer_id": F.col("customer_id"),
        "customer_unique_id": F.col("customer_unique_id"),
        "customer_state": F.col("customer_state"),
        "customer_city": F.col("customer_city"),
        "order_status": F.col("order_status"),
        "purchase_date": F.col("purchase_ts").cast("date"),
        "purchase_month": month_start(F.col("purchase_ts").cast("date")),
        "estimated_date": F.col("estimated_ts").cast("date"),
        "delivered_date": F.col("delivered_ts").cast("date"),
        "is_delivered": flag(F.col("is_delivered")),
        "is_cancelled": flag(F.col("is_cancelled")),
        "has_valid_delivery": flag(valid),
        "is_late": is_late(valid, F.col("delay_days")),
        "delivery_days": F.col("delivery_days"),
        "delay_days": F.col("delay_days"),
        "delay_bucket": band,
        "delay_bucket_order": band_order,
        "items_count": F.coalesce("items_count", F.lit(0)),
        "distinct_products": F.coalesce("distinct_products", F.lit(0)),
        "sellers_count": F.coalesce("sellers_count", F.lit(0)),
        "item_revenue": F.coalesce("item_revenue", no_money),
        "freight_value": F.coalesce("freight_value", no_money),
        "payment_value": F.col("payment_value"),
        "main_payment_type": F.col("main_payment_type"),
        "review_score": F.col("review_score"),
        "review_answered_before_delivery": answered_before_delivery(valid, F.col("review_answered_ts"), F.col("delivered_ts")),
    }


def parts_of(columns: Sequence[str]) -> list[str]:
    """The parts that some columns of the fact of orders come from."""
    return [part for part, names in ORDER_PARTS.items() if set(names) & set(columns)]


def orders_with(
    columns: Sequence[str],
    orders: DataFrame,
    customers: DataFrame | None = None,
    items: DataFrame | Sequence[DataFrame] | None = None,
    payments: DataFrame | None = None,
    reviews: DataFrame | None = None,
    kinds: DataFrame | None = None,
) -> DataFrame:
    """One row per order with some columns of the fact of orders; tables that none comes from are not read.

    Lines may come in several tables if all lines of an order are in one of them.
    """
    parts, joined = parts_of(columns), orders
    if "items" in parts:
        counted = {"distinct_products": "product_id", "sellers_count": "seller_id"}
        named = [key for name, key in counted.items() if name in columns]
        sums = [items_per_order(lines, named) for lines in ([items] if isinstance(items, DataFrame) else items)]
        joined = joined.join(reduce(DataFrame.unionByName, sums), "order_id", "left")
    if "payments" in parts:
        joined = joined.join(payments_per_order(payments, kinds), "order_id", "left")
    if "reviews" in parts:
        joined = joined.join(reviews.select("order_id", "review_score", "review_answered_ts"), "order_id", "left")
    if "customers" in parts:
        person = customers.select("customer_id", *ORDER_PARTS["customers"])
        joined = joined.join(person, "customer_id", "left")
    return joined.select(*[column.alias(name) for name, column in _order_columns().items() if name in columns])


def fact_orders(
    orders: DataFrame,
    customers: DataFrame,
    items: DataFrame | Sequence[DataFrame],
    payments: DataFrame,
    reviews: DataFrame,
    kinds: DataFrame | None = None,
) -> DataFrame:
    """One row per order."""
    return orders_with([*_order_columns()], orders, customers, items, payments, reviews, kinds)


def order_columns(orders: DataFrame, customers: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per order with the columns of `fact_orders` that don't come from lines or payments.

    Facts of lines, and questions that ask for no more, need neither lines nor their sums for them.
    """
    left_out = {*ORDER_PARTS["items"], *ORDER_PARTS["payments"]}
    return orders_with([c for c in _order_columns() if c not in left_out], orders, customers, reviews=reviews)


def lines_with_category(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Order items whose order is known, with the category and some columns of the order."""
    named = products.select("product_id", "category")
    lines = items.select("order_id", "product_id", "price", "freight_value").join(orders, "order_id")
    return lines.join(named, "product_id", "left").withColumn("category", F.coalesce("category", F.lit(UNKNOWN)))


def fact_order_items(
    items: DataFrame, orders_fact: DataFrame, products: DataFrame, sellers: DataFrame
) -> DataFrame:
    """One row per order item whose order is known."""
    return with_lookups(lines_of_orders(items, orders_fact), products, sellers)


def lines_of_orders(items: DataFrame, orders_fact: DataFrame) -> DataFrame:
    """Order items whose order is known, with the columns of the order."""
    order = orders_fact.select(
        "order_id",
        "customer_unique_id",
        "customer_state",
        "purchase_date",
        "purchase_month",
        "is_delivered",
        "has_valid_delivery",
        "is_late",
        "review_score",
    )
    return items.drop("shipping_limit_ts").join(order, "order_id")


def with_lookups(lines: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """The columns of the fact of order items from lines with the columns of their order."""
    return (
        lines.join(products.select("product_id", "category"), "product_id", "left")
        .join(sellers.select("seller_id", "seller_state"), "seller_id", "left")
        .select(
            "order_id",
            "order_item_id",
            "product_id",
            "seller_id",
            F.coalesce("category", F.lit(UNKNOWN)).alias("category"),
            "seller_state",
            "customer_unique_id",
            "customer_state",
            "purchase_date",
            "purchase_month",
            "is_delivered",
            "has_valid_delivery",
            "is_late",
            "review_score",
            "price",
            "freight_value",
        )
    )


def fact_payments(payments: DataFrame, orders_fact: DataFrame) -> DataFrame:
    """One row per payment line whose order is known."""
    order = orders_fact.select(
        "order_id", "purchase_date", "purchase_month", "is_delivered", "customer_state"
    )
    return payments.join(order, "order_id").select(
        "order_id",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
        "purchase_date",
        "purchase_month",
        "is_delivered",
        "customer_state",
    )


def dim_customer(orders_fact: DataFrame) -> DataFrame:
    """One row per person: place at the first order, cohort month, order counts."""
    delivered = F.col("is_delivered") == 1

    def at_first_order(column: str) -> Column:
        # The smallest (date, order) among the orders that hold a value; undated orders hold none.
        usable = F.col(column).isNotNull() & F.col("purchase_date").isNotNull()
        first = F.min(F.when(usable, F.struct("purchase_date", "order_id", column)))
        return first[column].alias(column)

    n_delivered = F.count_if(delivered)
    return (
        orders_fact.filter(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            at_first_order("customer_state"),
            at_first_order("customer_city"),
            F.min("purchase_date").alias("first_order_date"),
            month_start(F.min(F.when(delivered, F.col("purchase_date")))).alias("cohort_month"),
            F.count(F.lit(1)).alias("orders_placed"),
            n_delivered.alias("delivered_orders"),
            flag(n_delivered >= 2).alias("is_repeat_customer"),
        )
    )


def dim_product(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id",
        "category",
        "category_pt",
        "weight_g",
        "photos_qty",
        "length_cm",
        "height_cm",
        "width_cm",
    )


def dim_seller(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")


def brazil_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BRAZIL_STATES, "state_code string, state_name string, region string")


def dim_state(states: DataFrame, centroids: DataFrame, country: str = "Brazil") -> DataFrame:
    """States with region, a text place for geocoding, and the centre point if one is known."""
    return states.join(centroids, "state_code", "left").select(
        "state_code",
        "state_name",
        "region",
        F.concat("state_name", F.lit(f", {country}")).alias("map_location"),
        "latitude",
        "longitude",
    )


def dim_date(orders_fact: DataFrame) -> DataFrame:
    """One row per day of every calendar year that has an order."""
    span = orders_fact.agg(
        F.trunc(F.min("purchase_date"), "year").alias("first_day"),
        F.date_sub(
            F.add_months(F.trunc(F.max("purchase_date"), "year"), 12), 1
        ).alias("last_day"),
    )
    day = F.col("date")
    return span.select(
        F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("date")
    ).select(
        "date",
        F.year(day).cast("bigint").alias("year"),
        F.quarter(day).cast("bigint").alias("quarter"),
        F.month(day).cast("bigint").alias("month_number"),
        F.date_format(day, "MMM").alias("month_name"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        month_start(day).alias("month_start"),
        (F.weekday(day) + 1).cast("bigint").alias("weekday_number"),
        F.date_format(day, "EEE").alias("weekday_name"),
    )

