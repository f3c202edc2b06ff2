"""Raw text tables to typed tables with one row per key.

A value that cannot be read becomes NULL and never fails a job. Every deduplication states a full
order, so the row that survives does not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.columns import (
    blank_to_null,
    lower_trim,
    pad_zip,
    rounded,
    try_double,
    try_int,
    try_money,
    try_timestamp,
    upper_trim,
)
from marketspark.functions.ordering import (
    crowds,
    distinct_rows,
    exact_median,
    first_of_calm,
    first_per_key,
    first_per_key_by,
    marks_of_copies,
    with_marks,
)

# Statuses that end an order without a delivery, and the label of a missing category.
CANCELLED_STATUSES = ("canceled", "unavailable")
DELIVERED_STATUS = "delivered"
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Box:
    """Latitude/longitude limits; a point outside is not used."""

    south: float
    north: float
    west: float
    east: float

    def contains(self, lat: Column, lng: Column) -> Column:
        return lat.between(self.south, self.north) & lng.between(self.west, self.east)


# A rough box around Brazil, islands included.
BRAZIL = Box(south=-34, north=6, west=-74, east=-32)

_CASTS = {
    "int": try_int,
    "double": try_double,
    "money": try_money,
    "timestamp": try_timestamp,
}


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns by name to int, double, money or timestamp; bad text becomes NULL."""
    return df.withColumns({c: _CASTS[kind](F.col(c)) for c, kind in types.items()})


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.distinct()


def clean_customers(raw: DataFrame) -> DataFrame:
    """One row per customer_id, which is issued per order; the person is customer_unique_id."""
    one = first_per_key(raw, ["customer_id"], "customer_unique_id")
    return one.select(
        "customer_id",
        "customer_unique_id",
        pad_zip(F.col("customer_zip_code_prefix")).alias("customer_zip_code_prefix"),
        lower_trim(F.col("customer_city")).alias("customer_city"),
        upper_trim(F.col("customer_state")).alias("customer_state"),
    )


def clean_sellers(raw: DataFrame) -> DataFrame:
    one = first_per_key(raw, ["seller_id"], "seller_state")
    return one.select(
        "seller_id",
        pad_zip(F.col("seller_zip_code_prefix")).alias("seller_zip_code_prefix"),
        lower_trim(F.col("seller_city")).alias("seller_city"),
        upper_trim(F.col("seller_state")).alias("seller_state"),
    )


def category_names(raw_translation: DataFrame) -> DataFrame:
    """One English name for each source category name."""
    source = blank_to_null(F.col("product_category_name"))
    english = blank_to_null(F.col("product_category_name_english"))
    return raw_translation.groupBy(source.alias("category_pt")).agg(
        F.min(english).alias("category_en")
    )


def clean_products(raw: DataFrame, raw_translation: DataFrame) -> DataFrame:
    """Products with an English category; the flag tells a translation from an equal name.

    The product is deduplicated before the lookup, so the join sees each product once.
    """
    one = first_per_key(raw, ["product_id"], "product_category_name")
    source = blank_to_null(F.col("product_category_name"))
    named = one.withColumn("_source", source).join(
        category_names(raw_translation), F.col("_source") == F.col("category_pt"), "left"
    )
    return named.select(
        "product_id",
        F.coalesce("_source", F.lit(UNKNOWN)).alias("category_pt"),
        F.coalesce("category_en", "_source", F.lit(UNKNOWN)).alias("category"),
        F.col("category_en").isNotNull().alias("has_english_name"),
        try_int(F.col("product_name_length")).alias("name_length"),
        try_int(F.col("product_description_length")).alias("description_length"),
        try_int(F.col("product_photos_qty")).alias("photos_qty"),
        try_double(F.col("product_weight_g")).alias("weight_g"),
        try_double(F.col("product_length_cm")).alias("length_cm"),
        try_double(F.col("product_height_cm")).alias("height_cm"),
        try_double(F.col("product_width_cm")).alias("width_cm"),
    )


def _days(end: Column, start: Column) -> Column:
    """Days between two dates; the time of day does not count."""
    return F.datediff(end.cast("date"), start.cast("date")).cast("bigint")


def clean_orders(raw: DataFrame) -> DataFrame:
    """Typed orders with delivery flags. Status beats dates; days compare dates, not timestamps."""
    one = first_per_key(raw, ["order_id"], "order_purchase_timestamp")
    status = F.col("order_status")
    purchased, delivered = F.col("purchase_ts"), F.col("delivered_ts")
    valid = F.col("has_valid_delivery")
    usable_dates = (delivered >= purchased) & F.col("estimated_ts").isNotNull()
    return (
        one.select(
            "order_id",
            "customer_id",
            lower_trim(status).alias("order_status"),
            try_timestamp(F.col("order_purchase_timestamp")).alias("purchase_ts"),
            try_timestamp(F.col("order_approved_at")).alias("approved_ts"),
            try_timestamp(F.col("order_delivered_carrier_date")).alias("carrier_ts"),
            try_timestamp(F.col("order_delivered_customer_date")).alias("delivered_ts"),
            try_timestamp(F.col("order_estimated_delivery_date")).alias("estimated_ts"),
        )
        .withColumns(
            {
                "is_delivered": status == DELIVERED_STATUS,
                "is_cancelled": status.isin(*CANCELLED_STATUSES),
            }
        )
        .withColumn(
            "has_valid_delivery", F.coalesce(F.col("is_delivered") & usable_dates, F.lit(False))
        )
        .withColumns(
            {
                "delivery_days": F.when(valid, _days(delivered, purchased)),
                "delay_days": F.when(valid, _days(delivered, F.col("estimated_ts"))),
            }
        )
    )


LINE_KEY = ["order_id", "order_item_id"]


def crowded_orders(raw: DataFrame) -> DataFrame:
    """Digests of orders with very many lines."""
    return crowds(raw, "order_id")


def clean_order_items(raw: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """One row per (order_id, order_item_id).

    The kept row is the first one under a total order of all columns, so exact copies fall out of
    the same pass and no separate DISTINCT shuffle is needed. Lines of an order come to lie together, so sums for each
    order fold before they are shuffled; only orders with very many lines, `crowded`, are spread.
    """
    return _typed_lines(first_per_key_by(raw, "order_id", LINE_KEY, "product_id", crowded=crowded))


def calm_order_items(raw: DataFrame, crowded: DataFrame) -> DataFrame:
    """The rows of `clean_order_items` of all orders but those with very many lines."""
    return _typed_lines(first_of_calm(raw, "order_id", LINE_KEY, "product_id", crowded=crowded))


def crowded_order_items(raw: DataFrame, crowded: DataFrame) -> DataFrame:
    """The rows of `clean_order_items` of the orders with very many lines."""
    return _typed_lines(first_per_key(with_marks(raw, "order_id", crowded), LINE_KEY, "product_id"))


def _typed_lines(one: DataFrame) -> DataFrame:
    return one.select(
        "order_id",
        try_int(F.col("order_item_id")).alias("order_item_id"),
        "product_id",
        "seller_id",
        try_timestamp(F.col("shipping_limit_date")).alias("shipping_limit_ts"),
        try_money(F.col("price")).alias("price"),
        try_money(F.col("freight_value")).alias("freight_value"),
    )


def payment_lines(raw: DataFrame) -> DataFrame:
    """Normalised payment lines."""
    return raw.select(
        "order_id",
        try_int(F.col("payment_sequential")).alias("payment_sequential"),
        lower_trim(F.col("payment_type")).alias("payment_type"),
        try_int(F.col("payment_installments")).alias("payment_installments"),
        try_money(F.col("payment_value")).alias("payment_value"),
    )


def payment_marks(raw: DataFrame) -> DataFrame:
    """Digests that several normalised payment lines have."""
    return marks_of_copies(payment_lines(raw))


def clean_payments(raw: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Normalised payment lines; lines that become equal after normalisation are one line.

    With `marks`, the digests that several lines have, only lines with these are compared.
    """
    lines = payment_lines(raw)
    return drop_exact_duplicates(lines) if marks is None else distinct_rows(lines, marks)


def clean_reviews(raw: DataFrame) -> DataFrame:
    """The latest review of each order; review text stops here.

    The latest one is chosen before its score is checked, so an unusable score is not replaced by
    an older one.
    """
    slim = raw.select(
        "order_id",
        "review_id",
        try_int(F.col("review_score")).alias("review_score"),
        try_timestamp(F.col("review_creation_date")).alias("review_created_ts"),
        try_timestamp(F.col("review_answer_timestamp")).alias("review_answered_ts"),
    )
    latest = first_per_key(
        slim,
        ["order_id"],
        "review_answered_ts desc",
        "review_created_ts desc",
        "review_id",
    )
    score = F.col("review_score")
    return latest.withColumn("review_score", F.when(score.between(1, 5), score))


def geolocation_points(raw: DataFrame) -> DataFrame:
    return raw.select(
        upper_trim(F.col("geolocation_state")).alias("state_code"),
        try_double(F.col("geolocation_lat")).alias("lat"),
        try_double(F.col("geolocation_lng")).alias("lng"),
    )


def clean_state_centroids(raw: DataFrame, box: Box = BRAZIL) -> DataFrame:
    """Median point of each state, from the points inside the box.

    A state may hold a third of all points, so the medians come from value counts (exact_median); both
    axes go through the same pass.
    """
    inside = geolocation_points(raw).filter(box.contains(F.col("lat"), F.col("lng")))
    axes = F.array(
        F.struct(F.lit("latitude").alias("axis"), F.col("lat").alias("degrees")),
        F.struct(F.lit("longitude").alias("axis"), F.col("lng").alias("degrees")),
    )
    middle = exact_median(inside.select("state_code", F.inline(axes)), "degrees", ["state_code", "axis"])
    of = lambda axis: rounded(F.max(F.when(F.col("axis") == axis, F.col("median"))), 4).alias(axis)
    return middle.groupBy("state_code").agg(of("latitude"), of("longitude"))
