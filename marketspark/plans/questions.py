"""The twelve business questions over the star schema.

Each question is a function (model, params) -> DataFrame. Hot keys are safe because every question
first groups by a fine key (order, day or month of a person) with map-side partial aggregation, and
only the small result is windowed or ranked. A total is taken from that small result as well: a
subquery for it would scan the facts a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.columns import flag, mean, month_index, pct, ratio, rounded
from marketspark.functions.ordering import exact_median, global_rank
from marketspark.params import Params

Model = Mapping[str, DataFrame]

ALL_CATEGORIES = "ALL CATEGORIES"
PARTIAL_MONTH_SHARE = 0.1
ROUTES_SHOWN = 15


def delivered(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_delivered") == 1)


def _share(condition: Column) -> Column:
    """Percentage of rows that meet the condition, two decimals."""
    return rounded(F.avg(F.when(condition, 1).otherwise(0)) * 100, 2)


def _avg(column: str, digits: int) -> Column:
    return rounded(F.avg(F.col(column).cast("double")), digits)


def _with_partial(monthly: DataFrame) -> DataFrame:
    """A month with few orders next to the typical month is partial. One row for each month from here on."""
    typical = F.median("orders_placed").over(Window.partitionBy(F.lit(0)))
    partial = flag(F.col("orders_placed") < F.col("_typical") * PARTIAL_MONTH_SHARE)
    return monthly.withColumn("_typical", typical).withColumn("is_partial_month", partial).drop("_typical")


def months_placed(model: Model) -> DataFrame:
    """What `monthly_orders_revenue` says of whole months, without revenue: orders are enough to tell."""
    orders = model["fact_orders"].filter(F.col("purchase_month").isNotNull())
    return _with_partial(orders.groupBy("purchase_month").agg(F.count(F.lit(1)).alias("orders_placed")))


def monthly_orders_revenue(model: Model, params: Params) -> DataFrame:
    orders = model["fact_orders"].filter(F.col("purchase_month").isNotNull())
    done = F.col("is_delivered") == 1
    monthly = orders.groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("orders_placed"),
        F.count_if(done).alias("orders_delivered"),
        F.count_if(F.col("is_cancelled") == 1).alias("orders_cancelled"),
        F.coalesce(F.sum(F.when(done, F.col("item_revenue"))), F.lit(0).cast("decimal(32,2)")).alias(
            "revenue_delivered"
        ),
    )
    by_month = Window.partitionBy(F.lit(0)).orderBy("purchase_month")
    revenue = F.col("revenue_delivered")
    before = F.lag(revenue).over(by_month)
    partial = F.col("is_partial_month")
    both_full = (partial == 0) & (F.lag(partial).over(by_month) == 0)
    return (
        _with_partial(monthly)
        .select(
            "purchase_month",
            "orders_placed",
            "orders_delivered",
            "orders_cancelled",
            "revenue_delivered",
            mean(revenue, F.col("orders_delivered"), 2).alias("avg_order_value"),
            F.when(both_full, rounded(pct(revenue - before, before), 2)).alias("revenue_mom_pct"),
            "is_partial_month",
        )
        .orderBy("purchase_month")
    )


def person_days(model: Model) -> DataFrame:
    """Delivered orders of each person and day: a person has at most one row for a calendar day."""
    return (
        delivered(model["fact_orders"])
        .filter(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id", "purchase_date")
        .agg(F.count(F.lit(1)).alias("orders"))
    )


def repeat_customer_rate(model: Model, params: Params) -> DataFrame:
    by_person = Window.partitionBy("customer_unique_id").orderBy(
        F.col("purchase_date").asc_nulls_last()
    )
    day = F.col("purchase_date")
    first = F.col("_n") == 1
    # Undated orders sort last, so a dated first day is followed by the next dated day or by NULL.
    gap = F.datediff(F.lead(day).over(by_person), day)
    people = (
        person_days(model)
        .withColumns({"_n": F.row_number().over(by_person), "_gap": gap})
        .groupBy("customer_unique_id")
        .agg(
            F.sum("orders").alias("orders"),
            F.count("purchase_date").alias("days"),
            F.max(F.when(first & day.isNotNull(), F.col("orders"))).alias("first_day_orders"),
            F.max(F.when(first, F.col("_gap"))).alias("to_later_day"),
        )
        .withColumn(
            "to_second",
            F.when(F.col("first_day_orders") >= 2, F.lit(0)).otherwise(F.col("to_later_day")),
        )
    )
    per_order_id = (
        delivered(model["fact_orders"])
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(rounded(pct(F.count_if(F.col("n") >= 2), F.count(F.lit(1))), 2))
    )
    n, repeats = F.count(F.lit(1)), F.count_if(F.col("orders") >= 2)
    later = F.count_if(F.col("days") >= 2)
    same_day = F.count_if((F.col("orders") >= 2) & (F.col("days") == 1))
    # Days between orders are small integers, so a median keeps one counter for each number of days.
    return people.agg(
        n.alias("customers"),
        repeats.alias("repeat_customers"),
        rounded(pct(repeats, n), 2).alias("repeat_rate_pct"),
        rounded(ratio(F.sum("orders"), n), 3).alias("orders_per_customer"),
        F.median("to_second").alias("median_days_first_to_second_order"),
        same_day.alias("repeat_customers_same_day_only"),
        later.alias("customers_back_on_later_day"),
        rounded(pct(later, n), 2).alias("repeat_rate_pct_later_day"),
        F.median("to_later_day").alias("median_days_to_later_day_order"),
    ).select(
        "customers",
        "repeat_customers",
        "repeat_rate_pct",
        "orders_per_customer",
        "median_days_first_to_second_order",
        per_order_id.scalar().alias("repeat_rate_pct_if_counted_by_customer_id"),
        "repeat_customers_same_day_only",
        "customers_back_on_later_day",
        "repeat_rate_pct_later_day",
        "median_days_to_later_day_order",
    )


def category_orders(model: Model) -> DataFrame:
    """Delivered items by category and order; the order's review score is the same on each item.

    Two questions read it, so a warehouse keeps it as a table.
    """
    if "category_orders" in model:
        return model["category_orders"]
    return (
        delivered(model["fact_order_items"])
        .groupBy("category", "order_id")
        .agg(
            F.sum("price").alias("revenue"),
            F.sum("freight_value").alias("freight"),
            F.max("review_score").alias("review_score"),
        )
    )


def top_categories(model: Model, params: Params) -> DataFrame:
    sales = (
        category_orders(model)
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("revenue").alias("revenue"),
            F.avg("review_score").alias("avg_review"),
            F.count("review_score").alias("reviewed_orders"),
        )
        .withColumn("enough", F.col("orders") >= params.min_category_orders)
    )
    # One row for each category from here on.
    total = F.sum("revenue").over(Window.partitionBy(F.lit(0)))
    by_revenue = Window.partitionBy(F.lit(0)).orderBy(F.col("revenue").desc_nulls_last())
    by_review = Window.partitionBy("enough").orderBy(F.col("avg_review").desc_nulls_last())
    return sales.select(
        "category",
        "orders",
        "revenue",
        rounded(pct(F.col("revenue"), total), 2).alias("revenue_share_pct"),
        F.rank().over(by_revenue).cast("bigint").alias("revenue_rank"),
        rounded(F.col("avg_review"), 2).alias("avg_review"),
        "reviewed_orders",
        F.when(F.col("enough"), F.rank().over(by_review).cast("bigint")).alias("review_rank"),
        flag(F.col("enough")).alias("enough_orders"),
    ).orderBy("revenue_rank", "category")


def late_delivery_by_state(model: Model, params: Params) -> DataFrame:
    late = F.col("is_late") == 1
    n = F.count(F.lit(1))
    return (
        model["fact_orders"]
        .filter(F.col("has_valid_delivery") == 1)
        .groupBy("customer_state")
        .agg(
            n.alias("delivered_orders"),
            F.count_if(late).alias("late_orders"),
            rounded(F.avg("is_late") * 100, 2).alias("late_rate_pct"),
            _avg("delivery_days", 1).alias("avg_delivery_days"),
            rounded(F.avg(F.when(late, F.col("delay_days"))), 1).alias("avg_days_late_when_late"),
            flag(n >= params.min_state_orders).alias("enough_orders"),
        )
        .orderBy(
            F.col("late_rate_pct").desc_nulls_last(),
            F.col("delivered_orders").desc(),
            F.col("customer_state").asc_nulls_last(),
        )
    )


def _reviewed(model: Model) -> DataFrame:
    return model["fact_orders"].filter(
        (F.col("has_valid_delivery") == 1) & F.col("review_score").isNotNull()
    )


def review_late_vs_on_time(model: Model, params: Params) -> DataFrame:
    score, early = F.col("review_score"), F.col("review_answered_before_delivery")
    group = F.when(F.col("is_late") == 1, "late").otherwise("on_time")
    return (
        _reviewed(model)
        .groupBy(group.alias("delivery_group"))
        .agg(
            F.count(F.lit(1)).alias("orders_with_review"),
            _avg("review_score", 2).alias("avg_review"),
            rounded(F.stddev_samp("review_score"), 4).alias("sd_review"),
            _share(score <= 2).alias("low_review_pct"),
            _share(score == 5).alias("five_star_pct"),
            F.count_if(early == 1).alias("answered_before_delivery"),
            _share(early == 1).alias("answered_before_delivery_pct"),
            F.count_if(early == 0).alias("answered_after_delivery"),
            rounded(F.avg(F.when(early == 0, score)), 2).alias(
                "avg_review_answered_after_delivery"
            ),
        )
        .orderBy(F.col("delivery_group").desc())
    )


def freight_share(model: Model, params: Params) -> DataFrame:
    """Per category and in total. The roll-up runs over (category, order) rows, not over items."""
    n = F.count_distinct("order_id")
    rolled = (
        category_orders(model)
        .rollup("category")
        .agg(
            F.grouping("category").alias("_total"),
            n.alias("orders"),
            F.sum("revenue").alias("revenue"),
            F.sum("freight").alias("freight"),
        )
    )
    is_total = F.col("_total") == 1
    return (
        rolled.select(
            F.when(is_total, ALL_CATEGORIES).otherwise(F.col("category")).alias("category"),
            "orders",
            "revenue",
            "freight",
            rounded(pct(F.col("freight"), F.col("revenue")), 2).alias("freight_share_pct"),
            flag(is_total | (F.col("orders") >= params.min_category_orders)).alias("enough_orders"),
            "_total",
        )
        .orderBy(
            F.col("_total").desc(),
            F.col("freight_share_pct").desc_nulls_last(),
            F.col("category").asc_nulls_last(),
        )
        .drop("_total")
    )


def cohort_retention(model: Model, params: Params) -> DataFrame:
    """People active N months after their first delivered month.

    A person's orders collapse to one row for each month before the window looks for the first
    one, so the window group is bounded by the calendar.
    """
    months = (
        delivered(model["fact_orders"])
        .filter(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id", "purchase_month")
        .agg(F.lit(1).alias("_one"))
    )
    first = F.min("purchase_month").over(Window.partitionBy("customer_unique_id"))
    activity = (
        months.withColumn("cohort_month", first)
        .withColumn(
            "months_since_first",
            month_index(F.col("purchase_month")) - month_index(F.col("cohort_month")),
        )
        .filter(F.col("cohort_month").isNotNull())
        .groupBy("cohort_month", "months_since_first")
        .agg(F.count(F.lit(1)).alias("active_customers"))
    )
    at_start = F.when(F.col("months_since_first") == 0, F.col("active_customers"))
    return (
        activity.withColumn(
            "cohort_size", F.max(at_start).over(Window.partitionBy("cohort_month"))
        )
        .select(
            "cohort_month",
            "cohort_size",
            "months_since_first",
            "active_customers",
            rounded(pct(F.col("active_customers"), F.col("cohort_size")), 2).alias("retention_pct"),
        )
        .orderBy("cohort_month", F.col("months_since_first").asc_nulls_last())
    )


def seller_stats(model: Model) -> DataFrame:
    """Sums per seller over (seller, order) rows; averages are taken later, so sums can be added."""
    return (
        delivered(model["fact_order_items"])
        .groupBy("seller_id", "order_id")
        .agg(
            F.sum("price").alias("revenue"),
            F.max("is_late").alias("is_late"),
            F.max("review_score").alias("review_score"),
        )
        .groupBy("seller_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("revenue").alias("revenue"),
            F.sum("is_late").alias("late"),
            F.count("is_late").alias("dated"),
            F.sum("review_score").alias("stars"),
            F.count("review_score").alias("reviewed"),
        )
    )


def seller_ranking(model: Model, params: Params) -> DataFrame:
    # Read three times below, so a warehouse keeps it as a table; it has one row for each seller.
    stats = model["seller_stats"] if "seller_stats" in model else seller_stats(model)
    market = stats.agg(
        F.struct(
            ratio(F.sum("late"), F.sum("dated")).alias("late_rate"),
            ratio(F.sum("stars"), F.sum("reviewed")).alias("avg_review"),
        )
    )
    late_rate = ratio(F.col("late"), F.col("dated"))
    stars = ratio(F.col("stars"), F.col("reviewed"))
    kept = stats.filter(F.col("orders") >= params.min_seller_orders).select(
        "seller_id",
        "orders",
        "revenue",
        late_rate.alias("late_rate"),
        stars.alias("avg_review"),
    )
    seller = model["dim_seller"].select("seller_id", "seller_state")
    worse = (F.col("late_rate") > F.col("_market.late_rate")) & (
        F.col("avg_review") < F.col("_market.avg_review")
    )
    return (
        global_rank(kept, "revenue", "revenue_rank")
        .withColumn("_market", market.scalar())
        .join(seller, "seller_id", "left")
        .select(
            "seller_id",
            "seller_state",
            "orders",
            "revenue",
            "revenue_rank",
            rounded(F.col("late_rate") * 100, 2).alias("late_rate_pct"),
            rounded(F.col("avg_review"), 2).alias("avg_review"),
            flag(worse).alias("worse_than_marketplace"),
        )
        .orderBy("revenue_rank", F.col("seller_id").asc_nulls_last())
    )


def payment_types(model: Model, params: Params) -> DataFrame:
    per_order = (
        delivered(model["fact_payments"])
        .groupBy("payment_type", "order_id")
        .agg(
            F.sum("payment_value").alias("value"),
            F.sum("payment_installments").alias("instalments"),
            F.count("payment_installments").alias("lines"),
        )
    )
    rolled = per_order.rollup("payment_type").agg(
        F.grouping("payment_type").alias("_total"),
        F.count_distinct("order_id").alias("orders_using_type"),
        F.sum("value").alias("payment_value"),
        mean(F.sum("instalments"), F.sum("lines"), 2).alias("avg_installments"),
    )

    def in_total(column: str) -> Column:
        total_row = F.when(F.col("_total") == 1, F.col(column))
        return F.max(total_row).over(Window.partitionBy(F.lit(0)))

    def of_total(column: str) -> Column:
        return rounded(pct(F.col(column), F.col(f"_{column}")), 2)

    columns = ("orders_using_type", "payment_value")
    return (
        rolled.withColumns({f"_{c}": in_total(c) for c in columns})
        .filter("_total = 0")
        .select(
            "payment_type",
            "orders_using_type",
            of_total("orders_using_type").alias("pct_of_orders"),
            "payment_value",
            of_total("payment_value").alias("pct_of_value"),
            "avg_installments",
        )
        .orderBy(F.col("payment_value").desc_nulls_last(), F.col("payment_type").asc_nulls_last())
    )


def basket_size(model: Model, params: Params) -> DataFrame:
    orders = delivered(model["fact_orders"])
    middle = exact_median(orders, "item_revenue")
    n = F.count(F.lit(1))
    return orders.agg(
        n.alias("delivered_orders"),
        _avg("items_count", 3).alias("avg_items_per_order"),
        _avg("distinct_products", 3).alias("avg_distinct_products"),
        mean(F.sum("item_revenue"), n, 2).alias("avg_order_value"),
        _share(F.col("items_count") >= 2).alias("multi_item_order_pct"),
    ).select(
        "delivered_orders",
        "avg_items_per_order",
        "avg_distinct_products",
        "avg_order_value",
        rounded(middle.scalar(), 2).alias("median_order_value"),
        "multi_item_order_pct",
    )


def review_by_delay_bucket(model: Model, params: Params) -> DataFrame:
    return (
        _reviewed(model)
        .groupBy("delay_bucket_order", "delay_bucket")
        .agg(
            F.count(F.lit(1)).alias("orders_with_review"),
            _avg("review_score", 2).alias("avg_review"),
            _share(F.col("review_score") <= 2).alias("low_review_pct"),
            _share(F.col("review_answered_before_delivery") == 1).alias(
                "answered_before_delivery_pct"
            ),
        )
        .orderBy("delay_bucket_order")
    )


def worst_routes(model: Model, params: Params) -> DataFrame:
    late = F.col("is_late")
    return (
        model["fact_order_items"]
        .filter(F.col("has_valid_delivery") == 1)
        .groupBy("order_id", "seller_state", "customer_state")
        .agg(F.max(late).alias("is_late"))
        .groupBy("seller_state", "customer_state")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if(late == 1).alias("late_orders"),
            rounded(F.avg(late) * 100, 2).alias("late_rate_pct"),
        )
        .filter(F.col("orders") >= params.min_route_orders)
        .select(
            F.concat("seller_state", F.lit(" -> "), "customer_state").alias("route"),
            "seller_state",
            "customer_state",
            "orders",
            "late_orders",
            "late_rate_pct",
        )
        .orderBy(
            F.col("late_rate_pct").desc_nulls_last(),
            F.col("orders").desc(),
            F.col("route").asc_nulls_last(),
        )
        .limit(ROUTES_SHOWN)
    )


#: Questions that read nothing but columns of the fact of orders that don't come from lines or payments.
ORDERS_ALONE = (
    repeat_customer_rate,
    late_delivery_by_state,
    review_late_vs_on_time,
    cohort_retention,
    review_by_delay_bucket,
)
#: Questions that read few columns of the fact of orders, sums of lines among them, and no other table.
ORDERS_WITH = {
    monthly_orders_revenue: ("purchase_month", "is_delivered", "is_cancelled", "item_revenue"),
    basket_size: ("is_delivered", "items_count", "distinct_products", "item_revenue"),
}


@dataclass(frozen=True)
class Question:
    name: str
    text: str
    answer: Callable[[Model, Params], DataFrame]


QUESTIONS = tuple(
    Question(f"q{i:02d}_{fn.__name__}", text, fn)
    for i, (fn, text) in enumerate(
        (
            (monthly_orders_revenue, "How do orders and delivered revenue develop by month?"),
            (repeat_customer_rate, "How many customers order again, and how soon?"),
            (top_categories, "Which categories earn the most, and which are rated best?"),
            (late_delivery_by_state, "Where do deliveries miss the promised date?"),
            (review_late_vs_on_time, "Are late orders rated lower than punctual ones?"),
            (freight_share, "How large is freight next to the price of the goods?"),
            (cohort_retention, "What share of each monthly cohort buys again later?"),
            (seller_ranking, "Which sellers earn the most, and which serve customers worse?"),
            (payment_types, "How do customers pay, and in how many instalments?"),
            (basket_size, "How many items and how much money does an order hold?"),
            (review_by_delay_bucket, "Does the rating fall as the delay grows?"),
            (worst_routes, "Which seller-to-customer routes are late most often?"),
        ),
        start=1,
    )
)
