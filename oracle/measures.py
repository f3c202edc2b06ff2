"""Measures, page queries, reconciliation and exports in DuckDB SQL."""

from __future__ import annotations

from marketspark.plans.pipeline import ANSWER_FILES, QUESTION_TEXTS
from marketspark.sources.binding import PARAMS, RAW
from marketspark.sources.sinks import AGGREGATES, EXPORT_COLUMNS
from oracle.questions import QUESTIONS
from oracle.tables import TABLES

TABLES["order_star"] = """
SELECT f.*, d.*, s.state_code, s.state_name, s.region, c.customer_city AS home_city
FROM fact_orders AS f
LEFT JOIN dim_date AS d ON d.date = f.purchase_date
LEFT JOIN dim_state AS s ON s.state_code = f.customer_state
LEFT JOIN dim_customer AS c ON c.customer_unique_id = f.customer_unique_id"""
TABLES["item_star"] = """
SELECT i.*, d.year, z.seller_state AS shop_state, p.category AS product_category
FROM fact_order_items AS i
LEFT JOIN dim_date AS d ON d.date = i.purchase_date
LEFT JOIN dim_seller AS z ON z.seller_id = i.seller_id
LEFT JOIN dim_product AS p ON p.product_id = i.product_id"""
TABLES["month_revenue"] = """
SELECT month_start, sum(item_revenue) FILTER (is_delivered = 1) AS revenue
FROM order_star WHERE month_start IS NOT NULL GROUP BY month_start"""

_DONE = "FILTER (is_delivered = 1)"
MEASURES = {
    "orders_placed": "SELECT year, region, count(*) AS orders_placed FROM order_star GROUP BY ALL",
    "delivered_orders": f"SELECT quarter, count(*) {_DONE} AS delivered_orders FROM order_star WHERE year IN (1997, 1998) GROUP BY ALL",
    "revenue": f"SELECT region, sum(item_revenue) {_DONE} AS revenue FROM order_star WHERE year IN (1997, 1998) GROUP BY ALL",
    "average_order_value": f"SELECT year, CAST(sum(item_revenue) {_DONE} AS DOUBLE) / count(*) {_DONE} AS average_order_value FROM order_star WHERE region IN ('ASIA', 'EUROPE') GROUP BY ALL",
    "item_revenue": f"SELECT shop_state AS seller_state, sum(price) {_DONE} AS item_revenue FROM item_star GROUP BY ALL",
    "freight_share": f"SELECT product_category AS category, CAST(sum(freight_value) {_DONE} AS DOUBLE) / CAST(sum(price) {_DONE} AS DOUBLE) AS freight_share FROM item_star WHERE year IN (1997, 1998) GROUP BY ALL",
    "payment_value": f"SELECT payment_type, region, sum(payment_value) {_DONE} AS payment_value FROM fact_payments LEFT JOIN dim_state ON state_code = customer_state GROUP BY ALL",
    "customers": "SELECT customer_state, count(CASE WHEN delivered_orders > 0 THEN 1 END) AS customers FROM dim_customer GROUP BY ALL",
    "repeat_customers": "SELECT customer_state, count(CASE WHEN delivered_orders > 1 THEN 1 END) AS repeat_customers FROM dim_customer GROUP BY ALL",
    "repeat_rate": "SELECT count(CASE WHEN delivered_orders > 1 THEN 1 END) / count(CASE WHEN delivered_orders > 0 THEN 1 END) AS repeat_rate FROM dim_customer",
    "orders_with_delivery_date": "SELECT state_code, count(CASE WHEN has_valid_delivery = 1 THEN 1 END) AS orders_with_delivery_date FROM order_star GROUP BY ALL",
    "late_orders": "SELECT month_start, count(CASE WHEN is_late = 1 THEN 1 END) AS late_orders FROM order_star GROUP BY ALL",
    "late_rate": "SELECT home_city AS customer_city, CAST(count(CASE WHEN is_late = 1 THEN 1 END) AS DOUBLE) / nullif(count(is_late), 0) AS late_rate FROM order_star GROUP BY ALL",
    "avg_delivery_days": "SELECT weekday_name, CAST(sum(delivery_days) AS DOUBLE) / count(delivery_days) AS avg_delivery_days FROM order_star GROUP BY ALL",
    "avg_review_score": f"SELECT main_payment_type, CAST(sum(review_score) {_DONE} AS DOUBLE) / nullif(count(review_score) {_DONE}, 0) AS avg_review_score FROM order_star GROUP BY ALL",
    "low_review_share": f"SELECT delay_bucket, CAST(count(CASE WHEN review_score < 3 THEN 1 END) {_DONE} AS DOUBLE) / nullif(count(review_score) {_DONE}, 0) AS low_review_share FROM order_star GROUP BY ALL",
    "answered_before_delivery_share": "SELECT region, CAST(count(CASE WHEN review_answered_before_delivery = 1 AND review_score IS NOT NULL THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN has_valid_delivery = 1 THEN review_score END), 0) AS answered_before_delivery_share FROM order_star GROUP BY ALL",
    "avg_review_orders_in_category": "SELECT category, CAST(sum(review_score) AS DOUBLE) / count(*) AS avg_review_orders_in_category FROM (SELECT DISTINCT category, order_id, review_score FROM sold_items WHERE review_score IS NOT NULL) GROUP BY ALL",
    "revenue_mom": "SELECT n.month_start, CAST(n.revenue - b.revenue AS DOUBLE) / nullif(CAST(b.revenue AS DOUBLE), 0) AS revenue_mom FROM month_revenue AS n LEFT JOIN month_revenue AS b ON n.month_start = b.month_start + INTERVAL 1 MONTH",
}
SHOWN = {f"measure_{name}": sql for name, sql in MEASURES.items()}

_MATRIX = ", ".join(
    f"sum(CASE months_since_first WHEN {m} THEN retention_pct END) AS month_{m}" for m in range(1, 7)
)
SHOWN |= {
    "view_revenue_by_state": f"SELECT state_name, sum(item_revenue) {_DONE} AS revenue FROM order_star WHERE year IN (1997, 1998) GROUP BY ALL",
    "view_top_categories": "SELECT category, sum(price) AS item_revenue FROM sold_items GROUP BY category ORDER BY item_revenue DESC, category LIMIT 10",
    "view_payment_mix": f"SELECT payment_type, sum(payment_value) {_DONE} AS payment_value FROM fact_payments GROUP BY ALL",
    "view_cohort_matrix": f"SELECT cohort_month, {_MATRIX} FROM q_cohorts WHERE cohort_size >= {PARAMS.min_cohort_size} AND months_since_first IN (1, 2, 3, 4, 5, 6) GROUP BY ALL",
    "view_orders_per_customer": "SELECT delivered_orders, count(*) AS customers FROM dim_customer GROUP BY ALL",
    "view_experience_by_delay": """
        SELECT delay_bucket, CAST(sum(review_score) AS DOUBLE) / count(review_score) AS avg_review_score,
               CAST(count(CASE WHEN review_score < 3 THEN 1 END) AS DOUBLE) / count(review_score) AS low_review_share,
               CAST(count(CASE WHEN review_score IS NOT NULL AND review_answered_before_delivery = 1 THEN 1 END) AS DOUBLE)
                   / count(review_score) AS answered_before_delivery_share
        FROM dated_orders GROUP BY ALL""",
    "view_late_rate_by_state": f"""
        SELECT state_code, CAST(sum(is_late) AS DOUBLE) / count(*) AS late_rate, count(*) AS orders_with_delivery_date
        FROM order_star WHERE has_valid_delivery = 1 GROUP BY state_code HAVING count(*) >= {PARAMS.min_state_orders}""",
    "view_revenue_by_weekday": f"SELECT weekday_number, weekday_name, sum(item_revenue) {_DONE} AS revenue FROM order_star GROUP BY ALL",
}

# --- sources, exports, reconciliation ---

_MODEL = (
    "fact_orders",
    "fact_order_items",
    "fact_payments",
    "dim_customer",
    "dim_product",
    "dim_seller",
    "dim_state",
    "dim_date",
)


def _rows(pairs: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{label}' AS "table", count(*) AS rows FROM {source}""" for label, source in pairs
    )


_MODEL_ROWS = [(name, name) for name in _MODEL]
_RAW_COLUMNS = (
    "review_id, order_id, review_score, review_comment_title, review_comment_message, "
    "review_creation_date, review_answer_timestamp"
)
SHOWN |= {
    "folder_discovery": "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS "table", 'shop_{name}_dataset.csv' AS file, count(*) AS rows FROM raw_{name}"""
        for name in ("orders", "sellers", "products")
    ),
    "load_raw_text": f"SELECT {_RAW_COLUMNS} FROM raw_reviews",
    "normalise_columns": "SELECT product_id, product_name_length, product_category_name FROM raw_products",
    "schema_problems": """
        SELECT 'sellers' AS "table", 'shop_sellers_dataset.csv' AS file,
               CASE WHEN substr(seller_id, -1) IN ('0', '1', '2') THEN 'seller_state' ELSE '' END AS missing,
               count(*) AS rows
        FROM raw_sellers GROUP BY ALL
        UNION ALL SELECT 'products', 'shop_products_dataset.csv', '', count(*) FROM raw_products""",
    "load_summary": _rows([(f"raw_{name}", f"raw_{name}") for name in RAW]),
    "build_model": _rows(_MODEL_ROWS),
    "export_model": _rows(
        [*_MODEL_ROWS, ("agg_cohort_retention", "q_cohorts"), ("agg_worst_routes", "q_routes")]
    ),
    "export_privacy": "SELECT * FROM fact_order_items",
    "export_results": "\nUNION ALL\n".join(
        f"SELECT '{ANSWER_FILES[name]}' AS file, '{QUESTION_TEXTS[name]}' AS question, count(*) AS rows"
        f" FROM ({sql})"
        for name, sql in QUESTIONS.items()
    ),
}

# What the exports hold, as read back from disk: the same rows, column by column.
SHOWN |= {f"exported_{name}": f"SELECT {', '.join(columns)} FROM {name}" for name, columns in EXPORT_COLUMNS.items()}
SHOWN |= {f"exported_{name}": QUESTIONS[answer] for name, answer in AGGREGATES.items()}
SHOWN |= {f"exported_{ANSWER_FILES[name]}": sql for name, sql in QUESTIONS.items()}

_DELIVERED = "fact_orders WHERE is_delivered = 1"
_PAIRS = [
    ("delivered_orders", "sum(orders_delivered) FROM q_monthly", "monthly_orders_revenue: sum of orders_delivered", f"count(*) FROM {_DELIVERED}", "fact_orders: rows delivered"),
    ("revenue", "sum(revenue_delivered) FROM q_monthly", "monthly_orders_revenue: sum of revenue_delivered", f"sum(item_revenue) FROM {_DELIVERED}", "fact_orders: item_revenue of delivered orders"),
    ("revenue_by_category", "max(revenue) FROM q_freight WHERE category = 'ALL CATEGORIES'", "freight_share: revenue of the total row", "sum(price) FROM sold_items", "fact_order_items: price of delivered items"),
    ("freight", "max(freight) FROM q_freight WHERE category = 'ALL CATEGORIES'", "freight_share: freight of the total row", f"sum(freight_value) FROM {_DELIVERED}", "fact_orders: freight_value of delivered orders"),
    ("late_orders", "sum(late_orders) FROM q_states", "late_delivery_by_state: sum of late_orders", "sum(is_late) FROM fact_orders", "fact_orders: sum of is_late"),
    ("customers", "max(customers) FROM q_repeat", "repeat_customer_rate: customers", "count(*) FROM dim_customer WHERE delivered_orders > 0", "dim_customer: rows with a delivered order"),
    ("repeat_customers", "max(repeat_customers) FROM q_repeat", "repeat_customer_rate: repeat_customers", "sum(is_repeat_customer) FROM dim_customer", "dim_customer: sum of is_repeat_customer"),
]
SHOWN["reconciliation"] = "\nUNION ALL\n".join(
    f"""SELECT metric, CAST(a AS DECIMAL(38, 2)) AS sql_value, sql_source, CAST(b AS DECIMAL(38, 2)) AS export_value,
               export_source, abs(a - b) < 0.005 AS matches, CAST(a AS DECIMAL(38, 2)) AS expected_value
        FROM (SELECT '{metric}' AS metric, (SELECT {left}) AS a, '{left_text}' AS sql_source,
                     (SELECT {right}) AS b, '{right_text}' AS export_source)"""
    for metric, left, left_text, right, right_text in _PAIRS
)

# --- single cleaning and model steps ---

SHOWN |= {
    "try_cast_columns": """
        SELECT product_id, product_category_name, TRY_CAST(product_photos_qty AS INTEGER) AS product_photos_qty,
               TRY_CAST(product_description_length AS INTEGER) AS product_description_length,
               TRY_CAST(product_weight_g AS DOUBLE) AS product_weight_g FROM raw_products""",
    "blank_to_null": "SELECT product_id, nullif(trim(product_category_name), '') AS category FROM raw_products",
    "normalise_text": "SELECT customer_id, lower(trim(customer_city)) AS city, upper(trim(customer_state)) AS state FROM raw_customers",
    "pad_zip": "SELECT seller_id, lpad(trim(seller_zip_code_prefix), 5, '0') AS zip FROM raw_sellers",
    "dedupe_by_key": """
        SELECT * EXCLUDE (place) FROM (
            SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY customer_unique_id) AS place
            FROM raw_customers) WHERE place = 1""",
    "drop_exact_duplicates": "SELECT DISTINCT * FROM raw_order_items",
    "items_per_order": "SELECT * FROM order_items_summary",
    "payments_per_order": "SELECT * FROM order_payments_summary",
    "delay_columns": "SELECT order_id, is_late, delay_bucket, delay_bucket_order FROM fact_orders",
    "review_answered_before_delivery": "SELECT order_id, review_answered_before_delivery AS answered_early FROM fact_orders",
}
