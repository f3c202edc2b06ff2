"""Data-quality log: how many rows each cleaning rule touched.

A check is an aggregate expression over its table, and all checks of a table share one scan; reviews,
which are counted by two keys, have two. Checks that look for equal rows or for keys of another table
first fold the rows to one for each key, with its count and the counts of all conditions on single
rows, so a key that holds a third of the table is folded before it is shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.columns import rounded, try_double, try_int, try_timestamp
from marketspark.operators.clean import BRAZIL, UNKNOWN, Box

Tables = Mapping[str, DataFrame]

PAYMENT_TOLERANCE = 1
ZIP_LENGTH = 5


@dataclass(frozen=True)
class Check:
    name: str
    affected: Callable[[Box], Column]
    action: str


@dataclass(frozen=True)
class Source:
    """One scanned table: the frame to aggregate, its row count, and its checks. `on_write`: the frame is the table as it
    is written, so that the checks can be counted then. `lookups` are the checks that need the fold of `frame`.
    """

    table: str
    frame: Callable[[Tables], DataFrame]
    rows: Callable[[], Column]
    checks: tuple[Check, ...]
    on_write: bool = False
    #: The frame for checks on single rows alone, which need no fold by the key of a lookup.
    alone: Callable[[Tables], DataFrame] | None = None
    lookups: frozenset[str] = frozenset()


def _where(sql: str) -> Callable[[Box], Column]:
    return lambda box: F.count_if(F.expr(sql))


def _surplus(key: str) -> Callable[[Box], Column]:
    """Rows beyond one for each key."""
    return lambda box: F.count(F.lit(1)) - F.count_distinct(F.col(key))


def _count() -> Column:
    return F.count(F.lit(1))


def _copies(raw: DataFrame, *keep: str) -> DataFrame:
    """Equal rows collapse to one row of the columns to `keep` with its number of copies.

    Rows are folded by those columns and two digests of 64 bits, so the shuffle carries no wide rows. Only rows that share
    both digests with another one are compared whole: rows that merely look alike are told apart there.
    """
    missing = [F.col(c).isNull() for c in raw.columns]  # a hash passes over NULLs
    marked = raw.withColumns(
        {"_one": F.xxhash64(*raw.columns, *missing), "_two": F.xxhash64(F.lit(1), *missing, *raw.columns)}
    )
    folded = marked.groupBy(*keep, "_one", "_two").agg(F.count(F.lit(1)).alias("_copies"))
    met = folded.filter("_copies > 1").select("_one", "_two").distinct()
    whole = marked.join(met, ["_one", "_two"], "left_semi").groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_copies"))
    alone = folded.filter("_copies = 1").join(met, ["_one", "_two"], "left_anti")
    return alone.select(*keep, "_copies").unionByName(whole.select(*keep, "_copies"))


def _by_key(df: DataFrame, key: str, conditions: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each key with its number of rows, and of rows that meet each condition."""
    met = [F.count_if(F.expr(sql)).alias(name) for name, sql in (conditions or {}).items()]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"), *met)


def _each_row(name: str, conditions: Mapping[str, str]) -> Callable[[Tables], DataFrame]:
    """Rows as `_by_key` would give them if no two shared a key; what is not asked for is not read."""

    def frame(t: Tables) -> DataFrame:
        met = [F.coalesce(F.expr(sql), F.lit(False)).cast("bigint").alias(check) for check, sql in conditions.items()]
        return t[name].select(F.lit(1).cast("bigint").alias("_copies"), *met)

    return frame


def _looked_up(folded: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """`_found` is NULL if the lookup lacks the key."""
    return folded.join(lookup.select(key, F.lit(True).alias("_found")), key, "left")


def _summed(name: str) -> Callable[[Box], Column]:
    """Rows that met a condition before they were folded."""
    return lambda box: F.coalesce(F.sum(name), F.lit(0))


def _surplus_rows(box: Box) -> Column:
    """Rows beyond one for each key, of rows folded by the key; a NULL key is none."""
    key_rows = F.count(F.when(F.col("_key").isNotNull(), F.lit(1)))
    return _copies_total() - key_rows


def _raw_orders(t: Tables) -> DataFrame:
    return t["raw_orders"].withColumn(
        "_bought", try_timestamp(F.col("order_purchase_timestamp"))
    )


def _reviews_by(key: str, conditions: Mapping[str, str] | None = None) -> Callable[[Tables], DataFrame]:
    def frame(t: Tables) -> DataFrame:
        scored = t["raw_reviews"].select(
            F.col(key).alias("_key"), try_int(F.col("review_score")).alias("_score")
        )
        return _by_key(scored, "_key", conditions)

    return frame


def _raw_geolocation(t: Tables) -> DataFrame:
    return _copies(t["raw_geolocation"], "geolocation_lat", "geolocation_lng").withColumns(
        {
            "_lat": try_double(F.col("geolocation_lat")),
            "_lng": try_double(F.col("geolocation_lng")),
        }
    )


def _outside(box: Box) -> Column:
    inside = F.coalesce(box.contains(F.col("_lat"), F.col("_lng")), F.lit(False))
    return F.coalesce(F.sum(F.when(~inside, F.col("_copies"))), F.lit(0))


def _copies_total() -> Column:
    return F.coalesce(F.sum("_copies"), F.lit(0))


def _not_found(box: Box) -> Column:
    return F.coalesce(F.sum(F.when(F.col("_found").isNull(), F.col("_copies"))), F.lit(0))


#: Conditions on single rows of tables that are folded by a key for the sake of another check.
ORDER_CONDITIONS = {
    "orders_cancelled_or_unavailable": "is_cancelled",
    "orders_still_in_progress": "not is_delivered and not is_cancelled",
    "orders_delivered_but_no_delivery_date": "is_delivered and delivered_ts is null",
    "orders_delivered_before_purchase": "is_delivered and delivered_ts < purchase_ts",
    "orders_on_time_by_date_but_late_by_timestamp": "has_valid_delivery and delay_days = 0 and delivered_ts > estimated_ts",
    "orders_not_delivered_but_have_delivery_date": "not is_delivered and delivered_ts is not null",
}
ITEM_CONDITIONS = {"items_missing_or_non_positive_price": "price is null or price <= 0"}
REVIEW_CONDITIONS = {
    "reviews_score_missing_or_out_of_range": "not coalesce(_score between 1 and 5, false)"
}

SOURCES = (
    Source(
        "raw_orders",
        _raw_orders,
        _count,
        (
            Check("orders_duplicate_order_id", _surplus("order_id"), "one row for each order kept"),
            Check(
                "orders_unreadable_purchase_timestamp",
                _where("_bought is null"),
                "kept without a month, so absent from monthly and cohort answers",
            ),
        ),
    ),
    Source(
        "clean_orders",
        lambda t: _looked_up(
            _by_key(t["clean_orders"], "customer_id", ORDER_CONDITIONS), t["clean_customers"], "customer_id"
        ),
        _copies_total,
        (
            Check("orders_cancelled_or_unavailable", _summed("orders_cancelled_or_unavailable"), "left out of revenue, repeat and delivery figures"),
            Check("orders_still_in_progress", _summed("orders_still_in_progress"), "not delivered yet, so left out of revenue and delivery figures"),
            Check("orders_delivered_but_no_delivery_date", _summed("orders_delivered_but_no_delivery_date"), "in revenue, not in delivery figures"),
            Check("orders_delivered_before_purchase", _summed("orders_delivered_before_purchase"), "in revenue, not in delivery figures"),
            Check("orders_on_time_by_date_but_late_by_timestamp", _summed("orders_on_time_by_date_but_late_by_timestamp"), "on time, because dates are compared; would be late by the clock"),
            Check("orders_not_delivered_but_have_delivery_date", _summed("orders_not_delivered_but_have_delivery_date"), "the status decides: not delivered"),
            Check("orders_customer_not_found", _not_found, "in sales totals, not in customer figures"),
        ),
        alone=_each_row("clean_orders", ORDER_CONDITIONS),
        lookups=frozenset({"orders_customer_not_found"}),
    ),
    Source(
        "fact_orders",
        lambda t: t["fact_orders"],
        _count,
        (
            Check(
                "delivered_orders_without_items",
                _where("is_delivered = 1 and items_count = 0"),
                "kept with zero revenue",
            ),
            Check(
                "delivered_orders_without_review",
                _where("is_delivered = 1 and review_score is null"),
                "not in review figures",
            ),
            Check(
                "delivered_orders_payment_differs_from_items_plus_freight",
                _where(
                    "is_delivered = 1 and abs(coalesce(payment_value, 0)"
                    f" - (item_revenue + freight_value)) > {PAYMENT_TOLERANCE}"
                ),
                "for information: revenue follows item prices, not payments",
            ),
        ),
    ),
    Source(
        "raw_order_items",
        lambda t: _copies(t["raw_order_items"], "order_id", "order_item_id"),
        _copies_total,
        (
            Check(
                "items_exact_duplicate_rows",
                lambda box: _copies_total() - F.count(F.lit(1)),
                "removed",
            ),
            Check(
                "items_duplicate_order_item_key",
                lambda box: F.count(F.lit(1))
                - F.count_distinct(F.struct("order_id", "order_item_id")),
                "one row for each order line kept",
            ),
        ),
    ),
    Source(
        "clean_order_items",
        lambda t: _looked_up(
            _by_key(t["clean_order_items"], "order_id", ITEM_CONDITIONS), t["clean_orders"], "order_id"
        ),
        _copies_total,
        (
            Check(
                "items_missing_or_non_positive_price",
                _summed("items_missing_or_non_positive_price"),
                "kept; adds nothing to revenue",
            ),
            Check("items_order_not_found", _not_found, "not in the star schema"),
        ),
        alone=_each_row("clean_order_items", ITEM_CONDITIONS),
        lookups=frozenset({"items_order_not_found"}),
    ),
    Source(
        "clean_products",
        lambda t: t["clean_products"],
        _count,
        (
            Check(
                "products_missing_category",
                _where(f"category_pt = '{UNKNOWN}'"),
                f"labelled '{UNKNOWN}'",
            ),
            Check(
                "products_category_without_english_name",
                _where(f"category_pt <> '{UNKNOWN}' and not has_english_name"),
                "source name used",
            ),
        ),
        on_write=True,
    ),
    Source(
        "raw_reviews",
        _reviews_by("review_id", REVIEW_CONDITIONS),
        _copies_total,
        (
            Check(
                "reviews_review_id_reused",
                _surplus_rows,
                "for information: reviews belong to orders by order_id",
            ),
            Check(
                "reviews_score_missing_or_out_of_range",
                _summed("reviews_score_missing_or_out_of_range"),
                "score left empty",
            ),
        ),
    ),
    Source(
        "raw_reviews",
        _reviews_by("order_id"),
        _copies_total,
        (
            Check(
                "reviews_extra_reviews_for_same_order",
                _surplus_rows,
                "latest review of the order kept",
            ),
        ),
    ),
    Source(
        "clean_payments",
        lambda t: t["clean_payments"],
        _count,
        (
            Check(
                "payments_type_not_defined",
                _where("payment_type = 'not_defined'"),
                "kept as a payment type of its own",
            ),
            Check("payments_zero_value", _where("payment_value = 0"), "kept"),
        ),
        on_write=True,
    ),
    Source(
        "raw_customers",
        lambda t: t["raw_customers"],
        _count,
        (
            Check(
                "customers_zip_prefix_lost_leading_zero",
                _where(f"length(trim(customer_zip_code_prefix)) < {ZIP_LENGTH}"),
                "zeros restored on the left",
            ),
        ),
        on_write=True,
    ),
    Source(
        "raw_sellers",
        lambda t: t["raw_sellers"],
        _count,
        (
            Check(
                "sellers_zip_prefix_lost_leading_zero",
                _where(f"length(trim(seller_zip_code_prefix)) < {ZIP_LENGTH}"),
                "zeros restored on the left",
            ),
        ),
        on_write=True,
    ),
    Source(
        "raw_geolocation",
        _raw_geolocation,
        _copies_total,
        (
            Check(
                "geolocation_exact_duplicate_rows",
                lambda box: _copies_total() - F.count(F.lit(1)),
                "harmless: copies share one median point",
            ),
            Check(
                "geolocation_points_outside_brazil", _outside, "not used for the state points"
            ),
        ),
    ),
)

#: Checks beside the log, by name only.
MORE_SOURCES = (
    Source(
        "raw_payments",
        lambda t: _copies(t["raw_payments"]),
        _copies_total,
        (
            Check(
                "payments_exact_duplicate_rows",
                lambda box: _copies_total() - F.count(F.lit(1)),
                "removed",
            ),
        ),
    ),
)

CHECK_NAMES = tuple(check.name for source in SOURCES for check in source.checks)
MORE_NAMES = tuple(check.name for source in MORE_SOURCES for check in source.checks)


TABLE_ROWS = "table_rows"


def counted_on_write(box: Box = BRAZIL) -> dict[str, dict[str, Column]]:
    """Table -> the counts of its checks that can be taken while it is written."""
    return {
        s.table: {TABLE_ROWS: s.rows(), **{c.name: c.affected(box) for c in s.checks}} for s in SOURCES if s.on_write
    }


def _measured(source: Source, checks: list[Check], tables: Tables, box: Box) -> DataFrame:
    """One row with the rows of the table and the count of each check: those seen while it was written, or a scan."""
    alone = source.alone is not None and not source.lookups & {c.name for c in checks}
    frame = (source.alone if alone else source.frame)(tables)
    seen = getattr(tables, "seen", {}).get(source.table) if source.on_write else None
    if seen:
        known = [F.lit(seen[n]).cast("bigint").alias(n) for n in (TABLE_ROWS, *(c.name for c in checks))]
        return frame.sparkSession.range(1).select(*known)
    return frame.agg(
        source.rows().cast("bigint").alias(TABLE_ROWS),
        *[c.affected(box).cast("bigint").alias(c.name) for c in checks],
    )


def _table_log(source: Source, checks: list[Check], tables: Tables, box: Box) -> DataFrame:
    measured = _measured(source, checks, tables, box)
    lines = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("check"),
                F.lit(source.table).alias("table"),
                F.col(c.name).alias("rows_affected"),
                F.lit(c.action).alias("action"),
            )
            for c in checks
        ]
    )
    return measured.select("table_rows", F.inline(lines))


def quality_log(
    tables: Tables, names: Iterable[str] | None = None, box: Box = BRAZIL
) -> DataFrame:
    """One row for each check: rows affected, rows of the table, percentage and what was done."""
    wanted = set(CHECK_NAMES if names is None else names)
    if unknown := wanted - set(CHECK_NAMES + MORE_NAMES):
        raise ValueError(f"unknown checks: {sorted(unknown)}")
    parts = []
    for source in SOURCES + MORE_SOURCES:
        checks = [c for c in source.checks if c.name in wanted]
        if checks:
            parts.append(_table_log(source, checks, tables, box))
    share = rounded(F.try_divide(F.col("rows_affected") * 100.0, F.col("table_rows")), 3)
    return reduce(DataFrame.unionByName, parts).select(
        "check",
        "table",
        "rows_affected",
        "table_rows",
        F.coalesce(share, F.lit(0.0)).alias("pct_of_table"),
        "action",
    )
