"""Named SQL building blocks over the given tables; `with_tables` adds the ones a query uses."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {}

# --- raw text tables ---

TABLES["raw_orders"] = """
SELECT CAST(k AS VARCHAR) AS order_id,
       CASE WHEN k % 307 <> 0 THEN 'c' || k END AS customer_id,
       CASE WHEN k % 211 = 0 THEN NULL
            WHEN o_orderstatus = 'F' THEN CASE WHEN k % 5 = 0 THEN ' DELIVERED' ELSE 'delivered' END
            WHEN o_orderstatus = 'P' THEN CASE WHEN k % 2 = 0 THEN 'canceled' ELSE 'unavailable ' END
            ELSE 'shipped' END AS order_status,
       CASE WHEN k % 97 = 0 THEN 'not a date'
            WHEN k % 101 = 0 THEN strftime(d, '%Y')
            WHEN k % 89 = 0 THEN strftime(bought, '%Y/%m/%d %H:%M:%S')
            ELSE strftime(bought, '%Y-%m-%d %H:%M:%S') END AS order_purchase_timestamp,
       CASE WHEN k % 9 = 0 THEN '' ELSE strftime(bought + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') END
           AS order_approved_at,
       CASE WHEN k % 11 <> 0 THEN strftime(bought + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END
           AS order_delivered_carrier_date,
       CASE WHEN k % 67 <> 0 AND (o_orderstatus = 'F' OR k % 7 = 0)
            THEN strftime(arrived, '%Y-%m-%d %H:%M:%S') END AS order_delivered_customer_date,
       CASE WHEN k % 173 = 0 THEN '' ELSE strftime(promised, '%Y-%m-%d %H:%M:%S') END
           AS order_estimated_delivery_date
FROM (
    SELECT k, o_orderstatus, d,
           d + to_days(CAST(copy - 1 AS INTEGER)) + to_hours(k % 24) + to_minutes(k % 60) AS bought,
           d + to_days(days) + to_hours(k % 20) + to_minutes(30) AS arrived,
           d + to_days(promise) AS promised
    FROM (
        SELECT o_orderkey AS k, o_orderstatus, CAST(o_orderdate AS TIMESTAMP) AS d,
               CAST((o_orderkey * 7 + CAST(floor(o_totalprice) AS BIGINT)) % 45 AS INTEGER) - 2 AS days,
               7 + 7 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS promise,
               unnest(CASE WHEN o_orderkey % 83 = 0 THEN [1, 2] ELSE [1] END) AS copy
        FROM orders
    )
)"""

TABLES["raw_customers"] = """
SELECT 'c' || k AS customer_id,
       CASE WHEN copy = 2 THEN 'z' || k WHEN k % 3 = 0 THEN 'p' || k
            WHEN k % 3 = 1 THEN 'u' || o_custkey ELSE 'h' || (k // 12) END AS customer_unique_id,
       CASE WHEN k % 61 = 0 THEN CAST(k * 37 % 10000 AS VARCHAR)
            ELSE lpad(CAST(k * 37 % 100000 AS VARCHAR), 5, '0') END AS customer_zip_code_prefix,
       ' City ' || (c_nationkey % 7) AS customer_city,
       CASE WHEN k % 3 = 0 THEN lower(n_name) ELSE n_name || ' ' END AS customer_state
FROM (
    SELECT o_orderkey AS k, o_custkey, c_nationkey, n_name,
           unnest(CASE WHEN o_orderkey % 131 = 0 THEN [1, 2] ELSE [1] END) AS copy
    FROM orders
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderkey % 71 <> 0
)"""

TABLES["raw_order_items"] = """
SELECT CASE WHEN k % 113 = 0 THEN 'missing-' || k ELSE CAST(k AS VARCHAR) END AS order_id,
       CASE WHEN line = 7 AND k % 19 = 0 THEN '7.0' ELSE CAST(line AS VARCHAR) END AS order_item_id,
       CASE WHEN k % 109 <> 0 THEN 'p' || l_partkey END AS product_id,
       's' || l_suppkey AS seller_id,
       strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS shipping_limit_date,
       CASE WHEN k % 103 = 0 AND line = 1 THEN 'n/a' WHEN k % 107 = 0 AND line = 2 THEN '0'
            ELSE CAST(amount AS VARCHAR) END AS price,
       CAST(CAST(amount * tax AS DECIMAL(12, 2)) AS VARCHAR) AS freight_value
FROM (
    SELECT l_orderkey AS k, l_linenumber AS line, l_partkey, l_suppkey, l_shipdate,
           CAST(l_extendedprice AS DECIMAL(12, 2)) AS amount, CAST(l_tax AS DECIMAL(4, 2)) AS tax,
           unnest(CASE WHEN l_orderkey % 127 = 0 THEN [1, 2] ELSE [1] END) AS copy
    FROM lineitem
)"""

TABLES["raw_payments"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
       CAST(l_linenumber AS VARCHAR) AS payment_sequential,
       CASE WHEN l_orderkey % 137 = 0 THEN 'not_defined'
            ELSE CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN ' Boleto'
                 ELSE 'voucher' END END AS payment_type,
       CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS payment_installments,
       CASE WHEN l_orderkey % 137 = 0 THEN '0.00' WHEN l_orderkey % 10 = 0 THEN '50.00'
            ELSE CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR) END AS payment_value
FROM lineitem"""

TABLES["raw_reviews"] = """
SELECT 'r' || CASE WHEN e % 50 = 49 THEN e - 1 ELSE e END AS review_id,
       CAST((e // 2) * 3 AS VARCHAR) AS order_id,
       CASE WHEN e % 211 = 0 THEN 'five' WHEN e % 223 = 0 THEN '4.0'
            ELSE CAST(1 + CAST(floor(value) AS BIGINT) % 6 AS VARCHAR) END AS review_score,
       event_type AS review_comment_title,
       'said:' || chr(10) || props AS review_comment_message,
       strftime(made, '%Y-%m-%d %H:%M:%S') AS review_creation_date,
       CASE WHEN e % 41 <> 0
            THEN strftime(made + to_days(CAST(e % 30 AS INTEGER)) + to_hours(e % 24),
                          '%Y-%m-%d %H:%M:%S') END AS review_answer_timestamp
FROM (
    SELECT event_id AS e, event_type, props, value,
           TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(event_id * 7919 % 2404 AS INTEGER)) AS made
    FROM events
)"""

TABLES["raw_products"] = """
SELECT 'p' || k AS product_id,
       CASE WHEN k % 53 = 0 THEN ' ' WHEN copy = 2 THEN 'zzz' ELSE brand END AS product_category_name,
       CAST(length(p_name) AS VARCHAR) AS product_name_length,
       CASE WHEN k % 47 = 0 THEN '1e2' ELSE CAST(p_size * 10 AS VARCHAR) END
           AS product_description_length,
       CASE WHEN k % 43 = 0 THEN '2.7' ELSE CAST(p_size AS VARCHAR) END AS product_photos_qty,
       CASE WHEN k % 59 = 0 THEN 'heavy' ELSE CAST(weight AS VARCHAR) END AS product_weight_g,
       CAST(p_size AS VARCHAR) AS product_length_cm,
       CAST(p_size + 1 AS VARCHAR) AS product_height_cm,
       CASE WHEN k % 37 = 0 THEN '' ELSE CAST(p_size + 2 AS VARCHAR) END AS product_width_cm
FROM (
    SELECT p_partkey AS k, p_name, p_size, lower(replace(p_brand, '#', '_')) AS brand,
           CAST(p_retailprice AS DECIMAL(12, 2)) AS weight,
           unnest(CASE WHEN p_partkey % 149 = 0 THEN [1, 2] ELSE [1] END) AS copy
    FROM part
)"""

TABLES["raw_category_translation"] = """
SELECT brand AS product_category_name,
       unnest(CASE brand WHEN 'brand_3' THEN ['brand_3']
                         WHEN 'brand_7' THEN ['seventh', 'line seven']
                         ELSE [replace(brand, 'brand_', 'line ')] END)
           AS product_category_name_english
FROM (SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS brand FROM part)
WHERE brand NOT IN ('brand_5', 'brand_12')"""

TABLES["raw_sellers"] = """
SELECT 's' || s_suppkey AS seller_id,
       CASE WHEN s_suppkey % 13 = 0 THEN CAST(s_suppkey * 41 % 10000 AS VARCHAR)
            ELSE lpad(CAST(s_suppkey * 41 % 100000 AS VARCHAR), 5, '0') END AS seller_zip_code_prefix,
       'Town ' || (s_nationkey % 5) || ' ' AS seller_city,
       CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS seller_state
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

TABLES["raw_geolocation"] = """
SELECT lpad(CAST(k * 17 % 100000 AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
       CASE WHEN k % 151 = 0 THEN 'x' ELSE CAST(b * 0.005 - 30.0 AS VARCHAR) END AS geolocation_lat,
       CAST(b * -0.004 - 38.0 AS VARCHAR) AS geolocation_lng,
       'City ' || (c_nationkey % 7) AS geolocation_city,
       CASE WHEN k % 2 = 0 THEN lower(n_name) ELSE n_name END AS geolocation_state
FROM (
    SELECT c_custkey AS k, c_nationkey, n_name, CAST(c_acctbal AS DECIMAL(12, 2)) AS b,
           unnest(CASE WHEN c_custkey % 157 = 0 THEN [1, 2] ELSE [1] END) AS copy
    FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""

TABLES["states"] = """
SELECT upper(n_name) AS state_code, 'State ' || n_nationkey AS state_name, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey"""

# --- typed tables ---

TABLES["clean_customers"] = """
SELECT DISTINCT ON (customer_id) customer_id, customer_unique_id,
       lpad(trim(customer_zip_code_prefix), 5, '0') AS customer_zip_code_prefix,
       lower(trim(customer_city)) AS customer_city, upper(trim(customer_state)) AS customer_state
FROM raw_customers
ORDER BY raw_customers.customer_id, raw_customers.customer_unique_id, raw_customers.customer_zip_code_prefix,
         raw_customers.customer_city, raw_customers.customer_state"""

TABLES["clean_sellers"] = """
SELECT seller_id, lpad(trim(z), 5, '0') AS seller_zip_code_prefix, lower(trim(c)) AS seller_city,
       upper(trim(s)) AS seller_state
FROM (
    SELECT seller_id, min_by(seller_zip_code_prefix, seller_state) AS z,
           min_by(seller_city, seller_state) AS c, min(seller_state) AS s
    FROM raw_sellers GROUP BY seller_id
)"""

TABLES["category_names"] = """
SELECT nullif(trim(product_category_name), '') AS source_name,
       min(nullif(trim(product_category_name_english), '')) AS english_name
FROM raw_category_translation GROUP BY ALL"""

TABLES["clean_products"] = """
SELECT product_id, coalesce(source_name, 'unknown') AS category_pt,
       coalesce(english_name, source_name, 'unknown') AS category,
       english_name IS NOT NULL AS has_english_name,
       TRY_CAST(product_name_length AS INTEGER) AS name_length,
       TRY_CAST(product_description_length AS INTEGER) AS description_length,
       TRY_CAST(product_photos_qty AS INTEGER) AS photos_qty,
       TRY_CAST(product_weight_g AS DOUBLE) AS weight_g,
       TRY_CAST(product_length_cm AS DOUBLE) AS length_cm,
       TRY_CAST(product_height_cm AS DOUBLE) AS height_cm,
       TRY_CAST(product_width_cm AS DOUBLE) AS width_cm
FROM (
    SELECT * EXCLUDE (rn), nullif(trim(product_category_name), '') AS source_name
    FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY product_category_name) AS rn
          FROM raw_products)
    WHERE rn = 1
) LEFT JOIN category_names USING (source_name)"""

TABLES["clean_orders"] = """
SELECT order_id, customer_id, order_status, purchase_ts, approved_ts, carrier_ts, delivered_ts,
       estimated_ts, is_delivered, is_cancelled, usable AS has_valid_delivery,
       CASE WHEN usable THEN CAST(delivered_ts AS DATE) - CAST(purchase_ts AS DATE) END AS delivery_days,
       CASE WHEN usable THEN CAST(delivered_ts AS DATE) - CAST(estimated_ts AS DATE) END AS delay_days
FROM (
    SELECT *, order_status = 'delivered' AS is_delivered,
           order_status IN ('canceled', 'unavailable') AS is_cancelled,
           coalesce(order_status = 'delivered' AND purchase_ts <= delivered_ts
                    AND estimated_ts IS NOT NULL, false) AS usable
    FROM (
        SELECT DISTINCT ON (order_id) order_id, customer_id, lower(trim(order_status)) AS order_status,
               TRY_CAST(order_purchase_timestamp AS TIMESTAMP) AS purchase_ts,
               TRY_CAST(order_approved_at AS TIMESTAMP) AS approved_ts,
               TRY_CAST(order_delivered_carrier_date AS TIMESTAMP) AS carrier_ts,
               TRY_CAST(order_delivered_customer_date AS TIMESTAMP) AS delivered_ts,
               TRY_CAST(order_estimated_delivery_date AS TIMESTAMP) AS estimated_ts
        FROM raw_orders
        ORDER BY raw_orders.order_id, order_purchase_timestamp, raw_orders.customer_id,
                 raw_orders.order_status, order_approved_at, order_delivered_carrier_date
    )
)"""

TABLES["clean_order_items"] = """
SELECT order_id, TRY_CAST(order_item_id AS INTEGER) AS order_item_id, product_id, seller_id,
       TRY_CAST(shipping_limit_date AS TIMESTAMP) AS shipping_limit_ts,
       TRY_CAST(price AS DECIMAL(12, 2)) AS price,
       TRY_CAST(freight_value AS DECIMAL(12, 2)) AS freight_value
FROM (
    SELECT *, row_number() OVER (
        PARTITION BY order_id, order_item_id
        ORDER BY product_id, seller_id, shipping_limit_date, price, freight_value) AS place
    FROM raw_order_items
) WHERE place = 1"""

TABLES["clean_payments"] = """
SELECT order_id, TRY_CAST(payment_sequential AS INTEGER) AS payment_sequential,
       lower(trim(payment_type)) AS payment_type,
       TRY_CAST(payment_installments AS INTEGER) AS payment_installments,
       TRY_CAST(payment_value AS DECIMAL(12, 2)) AS payment_value
FROM raw_payments GROUP BY ALL"""

TABLES["clean_reviews"] = """
SELECT DISTINCT ON (order_id) order_id, review_id,
       CASE WHEN stars >= 1 AND stars <= 5 THEN stars END AS review_score,
       review_created_ts, review_answered_ts
FROM (
    SELECT order_id, review_id, TRY_CAST(review_score AS INTEGER) AS stars,
           TRY_CAST(review_creation_date AS TIMESTAMP) AS review_created_ts,
           TRY_CAST(review_answer_timestamp AS TIMESTAMP) AS review_answered_ts
    FROM raw_reviews
)
ORDER BY order_id, review_answered_ts DESC NULLS LAST, review_created_ts DESC NULLS LAST,
         review_id, stars"""

TABLES["points"] = """
SELECT upper(trim(geolocation_state)) AS state_code,
       TRY_CAST(geolocation_lat AS DOUBLE) AS lat, TRY_CAST(geolocation_lng AS DOUBLE) AS lng
FROM raw_geolocation"""

TABLES["clean_state_centroids"] = """
SELECT state_code, round(quantile_cont(lat, 0.5), 4) AS latitude,
       round(quantile_cont(lng, 0.5), 4) AS longitude
FROM points
WHERE lat >= -34 AND lat <= 6 AND lng >= -74 AND lng <= -32
GROUP BY state_code"""

# --- star schema ---

TABLES["order_items_summary"] = """
SELECT order_id, count(*) AS items_count, count(DISTINCT product_id) AS distinct_products,
       count(DISTINCT seller_id) AS sellers_count, sum(price) AS item_revenue,
       sum(freight_value) AS freight_value
FROM clean_order_items GROUP BY order_id"""

TABLES["order_payments_summary"] = """
SELECT t.order_id, t.payment_value, b.payment_type AS main_payment_type
FROM (SELECT order_id, sum(payment_value) AS payment_value FROM clean_payments GROUP BY order_id) AS t
LEFT JOIN (
    SELECT order_id, payment_type, row_number() OVER (
        PARTITION BY order_id ORDER BY payment_value DESC, payment_sequential, payment_type) AS place
    FROM clean_payments WHERE payment_type IS NOT NULL AND payment_value IS NOT NULL
) AS b ON b.order_id = t.order_id AND b.place = 1"""

TABLES["fact_orders"] = """
SELECT o.order_id, o.customer_id, c.customer_unique_id, c.customer_state, c.customer_city,
       o.order_status, CAST(o.purchase_ts AS DATE) AS purchase_date,
       CAST(date_trunc('month', o.purchase_ts) AS DATE) AS purchase_month,
       CAST(o.estimated_ts AS DATE) AS estimated_date, CAST(o.delivered_ts AS DATE) AS delivered_date,
       CAST(o.is_delivered AS INTEGER) AS is_delivered, CAST(o.is_cancelled AS INTEGER) AS is_cancelled,
       CAST(o.has_valid_delivery AS INTEGER) AS has_valid_delivery,
       CAST(b.pos > 1 AS INTEGER) AS is_late, o.delivery_days, o.delay_days,
       b.label AS delay_bucket, b.pos AS delay_bucket_order,
       coalesce(i.items_count, 0) AS items_count, coalesce(i.distinct_products, 0) AS distinct_products,
       coalesce(i.sellers_count, 0) AS sellers_count, coalesce(i.item_revenue, 0) AS item_revenue,
       coalesce(i.freight_value, 0) AS freight_value, p.payment_value, p.main_payment_type,
       r.review_score,
       CASE WHEN o.has_valid_delivery THEN CAST(r.review_answered_ts < o.delivered_ts AS INTEGER) END
           AS review_answered_before_delivery
FROM clean_orders AS o
LEFT JOIN clean_customers AS c ON c.customer_id = o.customer_id
LEFT JOIN order_items_summary AS i ON i.order_id = o.order_id
LEFT JOIN order_payments_summary AS p ON p.order_id = o.order_id
LEFT JOIN clean_reviews AS r ON r.order_id = o.order_id
LEFT JOIN (VALUES (1, -100000, 0, 'On time or early'), (2, 1, 3, '1-3 days late'),
                  (3, 4, 7, '4-7 days late'), (4, 8, 14, '8-14 days late'),
                  (5, 15, 100000, '15+ days late')) AS b(pos, lo, hi, label)
       ON o.delay_days BETWEEN b.lo AND b.hi"""

TABLES["fact_order_items"] = """
SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id,
       coalesce(p.category, 'unknown') AS category, s.seller_state, f.customer_unique_id,
       f.customer_state, f.purchase_date, f.purchase_month, f.is_delivered, f.has_valid_delivery,
       f.is_late, f.review_score, i.price, i.freight_value
FROM fact_orders AS f, clean_order_items AS i
LEFT JOIN clean_products AS p ON p.product_id = i.product_id
LEFT JOIN clean_sellers AS s ON s.seller_id = i.seller_id
WHERE f.order_id = i.order_id"""

TABLES["fact_payments"] = """
SELECT p.*, f.purchase_date, f.purchase_month, f.is_delivered, f.customer_state
FROM clean_payments AS p, fact_orders AS f WHERE p.order_id = f.order_id"""

TABLES["dim_customer"] = """
SELECT customer_unique_id,
       first(customer_state ORDER BY purchase_date, order_id)
           FILTER (customer_state IS NOT NULL AND purchase_date IS NOT NULL) AS customer_state,
       first(customer_city ORDER BY purchase_date, order_id)
           FILTER (customer_city IS NOT NULL AND purchase_date IS NOT NULL) AS customer_city,
       min(purchase_date) AS first_order_date,
       min(CASE WHEN is_delivered = 1 THEN purchase_month END) AS cohort_month,
       count(*) AS orders_placed, count(CASE WHEN is_delivered = 1 THEN 1 END) AS delivered_orders,
       CASE WHEN count(CASE WHEN is_delivered = 1 THEN 1 END) > 1 THEN 1 ELSE 0 END
           AS is_repeat_customer
FROM fact_orders WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id"""

TABLES["dim_product"] = """
SELECT product_id, category, category_pt, weight_g, photos_qty, length_cm, height_cm, width_cm
FROM clean_products"""

TABLES["dim_seller"] = """
SELECT seller_id, seller_zip_code_prefix, seller_city, seller_state FROM clean_sellers"""

TABLES["dim_state"] = """
SELECT states.*, state_name || ', Brazil' AS map_location, latitude, longitude
FROM states LEFT JOIN clean_state_centroids USING (state_code)"""

TABLES["dim_date"] = """
SELECT date, year(date) AS year, quarter(date) AS quarter, month(date) AS month_number,
       strftime(date, '%b') AS month_name, strftime(date, '%Y-%m') AS year_month,
       CAST(date_trunc('month', date) AS DATE) AS month_start, isodow(date) AS weekday_number,
       strftime(date, '%a') AS weekday_name
FROM (
    SELECT CAST(unnest(range(make_date(y0, 1, 1), make_date(y1 + 1, 1, 1), INTERVAL 1 DAY)) AS DATE)
               AS date
    FROM (SELECT CAST(min(year(purchase_date)) AS INTEGER) AS y0,
                 CAST(max(year(purchase_date)) AS INTEGER) AS y1 FROM fact_orders)
)"""


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in TABLES:
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(TABLES[name], found)
            found[name] = None


def with_tables(sql: str) -> str:
    """Prefix a query with the building blocks it names, in dependency order."""
    found: dict[str, None] = {}
    _needed(sql, found)
    if not found:
        return sql
    blocks = ",\n".join(f"{name} AS ({TABLES[name]})" for name in found)
    return f"WITH {blocks}\n{sql.strip()}"
