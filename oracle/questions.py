"""The twelve questions in DuckDB SQL."""

from __future__ import annotations

from marketspark.sources.binding import PARAMS
from oracle.tables import TABLES

TABLES["q_monthly"] = f"""
SELECT m.*, round(CAST(revenue_delivered AS DOUBLE) / nullif(orders_delivered, 0), 2) AS avg_order_value,
       CASE WHEN is_partial_month + lag(is_partial_month) OVER w = 0
            THEN round(CAST(100 * (revenue_delivered - lag(revenue_delivered) OVER w) AS DOUBLE)
                       / nullif(lag(revenue_delivered) OVER w, 0), 2) END AS revenue_mom_pct
FROM (
    SELECT *, CAST(orders_placed < 0.1 * quantile_cont(orders_placed, 0.5) OVER () AS INTEGER)
                  AS is_partial_month
    FROM (
        SELECT purchase_month, count(*) AS orders_placed,
               count(CASE WHEN is_delivered = 1 THEN 1 END) AS orders_delivered,
               count(CASE WHEN is_cancelled = 1 THEN 1 END) AS orders_cancelled,
               coalesce(sum(item_revenue) FILTER (is_delivered = 1), 0) AS revenue_delivered
        FROM fact_orders GROUP BY purchase_month HAVING purchase_month IS NOT NULL
    )
) AS m WINDOW w AS (ORDER BY purchase_month)"""

TABLES["delivered_by_person"] = """
SELECT customer_unique_id, count(*) AS n, list_sort(list(DISTINCT purchase_date)) AS days,
       list_sort(list(purchase_date) FILTER (purchase_date IS NOT NULL)) AS all_days
FROM fact_orders WHERE is_delivered = 1 AND customer_unique_id IS NOT NULL GROUP BY ALL"""

TABLES["person_gaps"] = """
SELECT customer_unique_id, n, len(list_filter(days, lambda d: d IS NOT NULL)) AS n_days,
       all_days[2] - all_days[1] AS second_gap,
       list_filter(days, lambda d: d IS NOT NULL)[2] - list_filter(days, lambda d: d IS NOT NULL)[1]
           AS later_gap
FROM delivered_by_person"""

TABLES["q_repeat"] = """
SELECT count(*) AS customers, count(CASE WHEN n > 1 THEN 1 END) AS repeat_customers,
       round(100.0 * count(CASE WHEN n > 1 THEN 1 END) / count(*), 2) AS repeat_rate_pct,
       round(CAST(sum(n) AS DOUBLE) / count(*), 3) AS orders_per_customer,
       quantile_cont(second_gap, 0.5) AS median_days_first_to_second_order,
       (SELECT round(100.0 * sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) / count(*), 2)
        FROM (SELECT count(*) AS n FROM fact_orders WHERE is_delivered = 1 GROUP BY customer_id))
           AS repeat_rate_pct_if_counted_by_customer_id,
       count(CASE WHEN n > 1 AND n_days = 1 THEN 1 END) AS repeat_customers_same_day_only,
       count(CASE WHEN n_days > 1 THEN 1 END) AS customers_back_on_later_day,
       round(100.0 * count(CASE WHEN n_days > 1 THEN 1 END) / count(*), 2) AS repeat_rate_pct_later_day,
       quantile_cont(later_gap, 0.5) AS median_days_to_later_day_order
FROM person_gaps"""

TABLES["sold_items"] = "SELECT * FROM fact_order_items WHERE is_delivered = 1"

TABLES["q_categories"] = f"""
SELECT category, orders, revenue,
       round(CAST(100 * revenue AS DOUBLE) / (SELECT sum(price) FROM sold_items), 2) AS revenue_share_pct,
       1 + (SELECT count(*) FROM category_sums AS o WHERE o.revenue > c.revenue) AS revenue_rank,
       round(stars, 2) AS avg_review, reviewed_orders,
       CASE WHEN orders >= {PARAMS.min_category_orders} THEN
           rank() OVER (PARTITION BY orders >= {PARAMS.min_category_orders}
                        ORDER BY stars DESC NULLS LAST) END AS review_rank,
       CASE WHEN orders >= {PARAMS.min_category_orders} THEN 1 ELSE 0 END AS enough_orders
FROM category_sums AS c"""

TABLES["category_sums"] = """
SELECT category, count(DISTINCT order_id) AS orders, sum(price) AS revenue,
       any_value(stars) AS stars, coalesce(any_value(reviewed_orders), 0) AS reviewed_orders
FROM sold_items LEFT JOIN (
    SELECT category, avg(review_score) AS stars, count(*) AS reviewed_orders
    FROM (SELECT category, order_id, review_score FROM sold_items
          WHERE review_score IS NOT NULL GROUP BY ALL)
    GROUP BY category) USING (category)
GROUP BY category"""

TABLES["dated_orders"] = "SELECT * FROM fact_orders WHERE has_valid_delivery = 1"

TABLES["q_states"] = f"""
SELECT customer_state, count(*) AS delivered_orders, count(nullif(is_late, 0)) AS late_orders,
       round(100.0 * avg(is_late), 2) AS late_rate_pct, round(avg(delivery_days), 1) AS avg_delivery_days,
       round(avg(CASE WHEN is_late = 1 THEN delay_days END), 1) AS avg_days_late_when_late,
       CASE WHEN count(*) >= {PARAMS.min_state_orders} THEN 1 ELSE 0 END AS enough_orders
FROM dated_orders GROUP BY customer_state"""

TABLES["q_reviews"] = """
SELECT CASE is_late WHEN 1 THEN 'late' ELSE 'on_time' END AS delivery_group,
       count(*) AS orders_with_review, round(avg(review_score), 2) AS avg_review,
       round(stddev_samp(review_score), 4) AS sd_review,
       round(100.0 * avg(CAST(review_score < 3 AS INTEGER)), 2) AS low_review_pct,
       round(100.0 * avg(CAST(review_score = 5 AS INTEGER)), 2) AS five_star_pct,
       count(nullif(review_answered_before_delivery, 0)) AS answered_before_delivery,
       round(100.0 * avg(coalesce(review_answered_before_delivery, 0)), 2)
           AS answered_before_delivery_pct,
       count(nullif(review_answered_before_delivery, 1)) AS answered_after_delivery,
       round(avg(CASE review_answered_before_delivery WHEN 0 THEN review_score END), 2)
           AS avg_review_answered_after_delivery
FROM dated_orders WHERE review_score IS NOT NULL GROUP BY 1"""

TABLES["q_freight"] = f"""
SELECT category, orders, revenue, freight,
       round(CAST(100 * freight AS DOUBLE) / nullif(revenue, 0), 2) AS freight_share_pct,
       CASE WHEN whole OR orders >= {PARAMS.min_category_orders} THEN 1 ELSE 0 END AS enough_orders
FROM (
    SELECT category, count(DISTINCT order_id) AS orders, sum(price) AS revenue,
           sum(freight_value) AS freight, false AS whole
    FROM sold_items GROUP BY category
    UNION ALL
    SELECT 'ALL CATEGORIES', count(DISTINCT order_id), sum(price), sum(freight_value), true
    FROM sold_items
)"""

TABLES["q_cohorts"] = """
SELECT d.cohort_month, z.people AS cohort_size, d.months_since_first, d.people AS active_customers,
       round(100.0 * d.people / z.people, 2) AS retention_pct
FROM cohort_activity AS d
JOIN cohort_activity AS z ON z.cohort_month = d.cohort_month AND z.months_since_first = 0"""

TABLES["cohort_activity"] = """
SELECT c.cohort_month, datediff('month', c.cohort_month, f.purchase_month) AS months_since_first,
       count(DISTINCT f.customer_unique_id) AS people
FROM fact_orders AS f JOIN dim_customer AS c USING (customer_unique_id)
WHERE f.is_delivered = 1 GROUP BY ALL"""

TABLES["seller_order_pairs"] = """
SELECT seller_id, order_id, sum(price) AS revenue, any_value(is_late) AS is_late,
       any_value(review_score) AS review_score
FROM sold_items GROUP BY seller_id, order_id"""

TABLES["q_sellers"] = f"""
SELECT seller_id, seller_state, orders, revenue, rank() OVER (ORDER BY revenue DESC) AS revenue_rank,
       round(100.0 * late_rate, 2) AS late_rate_pct, round(stars, 2) AS avg_review,
       CAST(late_rate > (SELECT avg(is_late) FROM seller_order_pairs)
            AND stars < (SELECT avg(review_score) FROM seller_order_pairs) AS INTEGER)
           AS worse_than_marketplace
FROM (
    SELECT seller_id, count(*) AS orders, sum(revenue) AS revenue, avg(is_late) AS late_rate,
           avg(review_score) AS stars
    FROM seller_order_pairs GROUP BY seller_id HAVING count(*) >= {PARAMS.min_seller_orders}
) LEFT JOIN dim_seller USING (seller_id)"""

TABLES["paid"] = "SELECT * FROM fact_payments WHERE is_delivered = 1"

TABLES["q_payments"] = """
SELECT payment_type, count(DISTINCT order_id) AS orders_using_type,
       round(100.0 * count(DISTINCT order_id) / (SELECT count(DISTINCT order_id) FROM paid), 2)
           AS pct_of_orders,
       sum(payment_value) AS payment_value,
       round(CAST(100 * sum(payment_value) AS DOUBLE) / (SELECT sum(payment_value) FROM paid), 2)
           AS pct_of_value,
       round(avg(payment_installments), 2) AS avg_installments
FROM paid GROUP BY payment_type"""

TABLES["q_basket"] = """
SELECT count(*) AS delivered_orders, round(avg(items_count), 3) AS avg_items_per_order,
       round(avg(distinct_products), 3) AS avg_distinct_products,
       round(CAST(sum(item_revenue) AS DOUBLE) / count(*), 2) AS avg_order_value,
       round(quantile_cont(CAST(item_revenue AS DOUBLE), 0.5), 2) AS median_order_value,
       round(100.0 * avg(CAST(items_count > 1 AS INTEGER)), 2) AS multi_item_order_pct
FROM fact_orders WHERE is_delivered = 1"""

TABLES["q_buckets"] = """
SELECT delay_bucket_order, any_value(delay_bucket) AS delay_bucket, count(*) AS orders_with_review,
       round(avg(review_score), 2) AS avg_review,
       round(100.0 * avg(CAST(review_score < 3 AS INTEGER)), 2) AS low_review_pct,
       round(100.0 * avg(coalesce(review_answered_before_delivery, 0)), 2)
           AS answered_before_delivery_pct
FROM dated_orders WHERE review_score IS NOT NULL GROUP BY delay_bucket_order"""

TABLES["q_routes"] = f"""
SELECT seller_state || ' -> ' || customer_state AS route, seller_state, customer_state,
       count(DISTINCT order_id) AS orders, count(DISTINCT CASE WHEN is_late = 1 THEN order_id END) AS late_orders,
       round(100.0 * (count(DISTINCT CASE WHEN is_late = 1 THEN order_id END)
                      / count(DISTINCT order_id)), 2) AS late_rate_pct
FROM fact_order_items WHERE has_valid_delivery = 1
GROUP BY seller_state, customer_state HAVING count(DISTINCT order_id) >= {PARAMS.min_route_orders}
ORDER BY late_rate_pct DESC, orders DESC, route LIMIT 15"""

QUESTIONS = {
    "monthly_orders_revenue": "SELECT * FROM q_monthly",
    "repeat_customer_rate": "SELECT * FROM q_repeat",
    "top_categories": "SELECT * FROM q_categories",
    "late_delivery_by_state": "SELECT * FROM q_states",
    "review_late_vs_on_time": "SELECT * FROM q_reviews",
    "freight_share": "SELECT * FROM q_freight",
    "cohort_retention": "SELECT * FROM q_cohorts",
    "seller_ranking": "SELECT * FROM q_sellers",
    "payment_types": "SELECT * FROM q_payments",
    "basket_size": "SELECT * FROM q_basket",
    "review_by_delay_bucket": "SELECT * FROM q_buckets",
    "worst_routes": "SELECT * FROM q_routes",
}
