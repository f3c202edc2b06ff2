"""One scalar count for each data-quality check, in DuckDB SQL."""

from __future__ import annotations

from marketspark.operators.quality import MORE_SOURCES, SOURCES

COUNTS = {
    "orders_duplicate_order_id": "SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM raw_orders GROUP BY order_id)",
    "orders_unreadable_purchase_timestamp": "SELECT count(*) - count(TRY_CAST(order_purchase_timestamp AS TIMESTAMP)) FROM raw_orders",
    "orders_cancelled_or_unavailable": "SELECT count(*) FROM clean_orders WHERE order_status IN ('unavailable', 'canceled')",
    "orders_still_in_progress": "SELECT count(*) FROM clean_orders WHERE order_status NOT IN ('delivered', 'unavailable', 'canceled')",
    "orders_delivered_but_no_delivery_date": "SELECT count(*) - count(delivered_ts) FROM clean_orders WHERE order_status = 'delivered'",
    "orders_delivered_before_purchase": "SELECT count(*) FROM clean_orders WHERE order_status = 'delivered' AND purchase_ts > delivered_ts",
    "orders_on_time_by_date_but_late_by_timestamp": "SELECT count(*) FROM clean_orders WHERE delay_days = 0 AND estimated_ts < delivered_ts",
    "orders_not_delivered_but_have_delivery_date": "SELECT count(delivered_ts) FROM clean_orders WHERE order_status <> 'delivered'",
    "orders_customer_not_found": "SELECT count(*) FROM clean_orders AS o WHERE NOT EXISTS (FROM clean_customers AS c WHERE c.customer_id = o.customer_id)",
    "delivered_orders_without_items": "SELECT count(*) FROM clean_orders WHERE is_delivered AND order_id NOT IN (SELECT order_id FROM clean_order_items)",
    "delivered_orders_without_review": "SELECT count(*) FROM clean_orders WHERE is_delivered AND order_id NOT IN (SELECT order_id FROM clean_reviews WHERE review_score IS NOT NULL)",
    "delivered_orders_payment_differs_from_items_plus_freight": "SELECT count(*) FROM fact_orders WHERE is_delivered = 1 AND (item_revenue + freight_value - coalesce(payment_value, 0)) NOT BETWEEN -1 AND 1",
    "items_exact_duplicate_rows": "SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM raw_order_items GROUP BY order_id, order_item_id, product_id, seller_id, shipping_limit_date, price, freight_value)",
    "items_duplicate_order_item_key": "SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_order_items)) - (SELECT count(*) FROM clean_order_items)",
    "items_missing_or_non_positive_price": "SELECT count(*) FROM clean_order_items WHERE coalesce(price, 0) <= 0",
    "items_order_not_found": "SELECT count(*) FROM clean_order_items WHERE order_id NOT IN (SELECT order_id FROM clean_orders)",
    "products_missing_category": "SELECT count(*) FROM clean_products WHERE category = 'unknown'",
    "products_category_without_english_name": "SELECT count(*) FROM clean_products WHERE NOT has_english_name AND category <> 'unknown'",
    "reviews_review_id_reused": "SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM raw_reviews GROUP BY review_id)",
    "reviews_extra_reviews_for_same_order": "SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM raw_reviews GROUP BY order_id)",
    "reviews_score_missing_or_out_of_range": "SELECT count(*) FROM raw_reviews WHERE coalesce(TRY_CAST(review_score AS INTEGER), 0) NOT IN (1, 2, 3, 4, 5)",
    "payments_exact_duplicate_rows": "SELECT (SELECT count(*) FROM raw_payments) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_payments))",
    "payments_type_not_defined": "SELECT count(*) FROM clean_payments WHERE payment_type = 'not_defined'",
    "payments_zero_value": "SELECT count(*) FROM clean_payments WHERE payment_value = 0.00",
    "customers_zip_prefix_lost_leading_zero": "SELECT count(*) FROM raw_customers WHERE len(trim(customer_zip_code_prefix)) <= 4",
    "sellers_zip_prefix_lost_leading_zero": "SELECT count(*) FROM raw_sellers WHERE len(trim(seller_zip_code_prefix)) <= 4",
    "geolocation_exact_duplicate_rows": "SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM raw_geolocation GROUP BY geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city, geolocation_state)",
    "geolocation_points_outside_brazil": "SELECT count(*) - count(CASE WHEN lat BETWEEN -34 AND 6 AND lng BETWEEN -74 AND -32 THEN 1 END) FROM points",
}


def _line(table: str, check: str, action: str) -> str:
    text = action.replace("'", "''")
    return f"""
SELECT check_name AS "check", table_name AS "table", CAST(affected AS BIGINT) AS rows_affected, total AS table_rows,
       round(100.0 * affected / total, 3) AS pct_of_table, '{text}' AS action
FROM (SELECT '{check}' AS check_name, '{table}' AS table_name, ({COUNTS[check]}) AS affected,
             (SELECT count(*) FROM {table}) AS total)"""


LINES = {c.name: _line(s.table, c.name, c.action) for s in SOURCES + MORE_SOURCES for c in s.checks}
LOG = "\nUNION ALL\n".join(LINES[c.name] for s in SOURCES for c in s.checks)
