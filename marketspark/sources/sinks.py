"""Exports: the star schema, the ready-made aggregates, the answers and their index."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.sources.store import PARTITION_COLUMN, STORED_BY_MONTH, side_by_side

MONTH_PARTITIONED = ("fact_orders", "fact_order_items", "fact_payments")

# The columns of each exported table. Nothing else leaves, so no review text can.
EXPORT_COLUMNS: dict[str, tuple[str, ...]] = {
    "fact_orders": (
        "order_id",
        "customer_id",
        "customer_unique_id",
        "customer_state",
        "customer_city",
        "order_status",
        "purchase_date",
        "purchase_month",
        "estimated_date",
        "delivered_date",
        "is_delivered",
        "is_cancelled",
        "has_valid_delivery",
        "is_late",
        "delivery_days",
        "delay_days",
        "delay_bucket",
        "delay_bucket_order",
        "items_count",
        "distinct_products",
        "sellers_count",
        "item_revenue",
        "freight_value",
        "payment_value",
        "main_payment_type",
        "review_score",
        "review_answered_before_delivery",
    ),
    "fact_order_items": (
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        "category",
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
    ),
    "fact_payments": (
        "order_id",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
        "purchase_date",
        "purchase_month",
        "is_delivered",
        "customer_state",
    ),
    "dim_customer": (
        "customer_unique_id",
        "customer_state",
        "customer_city",
        "first_order_date",
        "cohort_month",
        "orders_placed",
        "delivered_orders",
        "is_repeat_customer",
    ),
    "dim_product": (
        "product_id",
        "category",
        "category_pt",
        "weight_g",
        "photos_qty",
        "length_cm",
        "height_cm",
        "width_cm",
    ),
    "dim_seller": ("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"),
    "dim_state": ("state_code", "state_name", "region", "map_location", "latitude", "longitude"),
    "dim_date": (
        "date",
        "year",
        "quarter",
        "month_number",
        "month_name",
        "year_month",
        "month_start",
        "weekday_number",
        "weekday_name",
    ),
}

#: Exported aggregate -> the answer it holds.
AGGREGATES = {
    "agg_cohort_retention": "cohort_retention",
    "agg_worst_routes": "worst_routes",
}


#: CSV as other tools write it: doubled quotes, and no blank trimmed from a value.
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_files(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    multi_line: bool = False,
    partition_by: str | None = None,
    gathered: bool = False,
) -> DataFrame:
    """Write in parallel parts, and return what is on disk, read back with the same schema.

    `multi_line` is for text columns that may hold line breaks: such CSV files are read unsplit. With
    `partition_by` there is a folder for each value, gathered into few files, but split if it is large;
    `gathered` says that the rows are stored that way already, so that they need no shuffle for it.
    """
    reader = df.sparkSession.read.schema(df.schema)
    if partition_by:
        rows = df if gathered else df.hint("rebalance", F.col(partition_by))
        writer = rows.write.partitionBy(partition_by)
    else:
        writer = df.write
    writer = writer.mode("overwrite")
    if fmt == "csv":
        writer, reader = writer.options(**CSV), reader.options(**CSV, multiLine=multi_line)
    writer.format(fmt).save(path)
    return reader.format(fmt).load(path).select(df.columns)


def export_table(
    model: Mapping[str, DataFrame],
    answers: Mapping[str, DataFrame],
    name: str,
    folder: str,
    fmt: str = "csv",
    stored: bool = False,
) -> DataFrame:
    """Write one exported table; facts have a folder for each purchase month. `stored`: the model is that of a lake."""
    if name in AGGREGATES:
        return write_files(answers[AGGREGATES[name]], f"{folder}/{name}", fmt)
    df = model[name].select(*EXPORT_COLUMNS[name])
    month = PARTITION_COLUMN if name in MONTH_PARTITIONED else None
    return write_files(df, f"{folder}/{name}", fmt, partition_by=month, gathered=stored and name in STORED_BY_MONTH)


def export_model(
    model: Mapping[str, DataFrame],
    answers: Mapping[str, DataFrame],
    folder: str,
    fmt: str = "csv",
    stored: bool = False,
) -> dict[str, DataFrame]:
    """Write each table under `folder`, and return what is on disk, re-read. `stored`: the model is that of a lake."""
    spark = next(iter(model.values())).sparkSession
    return export_each(spark, lambda n: export_table(model, answers, n, folder, fmt, stored))


def export_each(spark: SparkSession, write: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """Every exported table by its name: facts one after another, so that one of them is shuffled at a time, and the
    small tables beside them."""
    names = [*EXPORT_COLUMNS, *AGGREGATES]
    rest = [(name,) for name in names if name not in MONTH_PARTITIONED]
    done = side_by_side(spark, lambda some: {name: write(name) for name in some}, [MONTH_PARTITIONED, *rest])
    found = {name: df for some in done for name, df in some.items()}
    return {name: found[name] for name in names}


def results_index(
    answers: Mapping[str, DataFrame], texts: Mapping[str, str], names: Mapping[str, str]
) -> DataFrame:
    """(file, question, rows) of each answer."""
    lines = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(names[key]).alias("file"), F.lit(texts[key]).alias("question"), "rows"
        )
        for key, df in answers.items()
    ]
    return reduce(DataFrame.unionByName, lines)


INDEX = "file string, question string, rows bigint"


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index that `export_results` wrote as CSV."""
    return spark.read.schema(INDEX).options(**CSV).csv(f"{folder}/index")


def export_results(
    answers: Mapping[str, DataFrame],
    texts: Mapping[str, str],
    names: Mapping[str, str],
    folder: str,
    fmt: str = "csv",
) -> DataFrame:
    """Write every answer and the index, and return the index."""
    spark = next(iter(answers.values())).sparkSession
    side_by_side(
        spark, lambda key: write_files(answers[key], f"{folder}/{names[key]}", fmt), answers
    )
    index = results_index(answers, texts, names)
    return write_files(index, f"{folder}/index", fmt)
