"""Decision facts, dashboard queries and the fact set in DuckDB SQL."""

from __future__ import annotations

from marketspark.plans.catalog import LABEL, MADE_ON
from marketspark.sources.binding import PARAMS
from oracle.tables import TABLES

TABLES["late_side"] = "SELECT * FROM q_reviews WHERE delivery_group = 'late'"
TABLES["on_time_side"] = "SELECT * FROM q_reviews WHERE delivery_group = 'on_time'"

TABLES["f_gap"] = """
SELECT round(gap, 6) AS review_gap, round(gap - 1.96 * se, 6) AS review_gap_ci_low,
       round(gap + 1.96 * se, 6) AS review_gap_ci_high
FROM (
    SELECT o.avg_review - l.avg_review AS gap,
           sqrt(power(o.sd_review, 2) / o.orders_with_review
                + power(l.sd_review, 2) / l.orders_with_review) AS se
    FROM on_time_side AS o, late_side AS l
)"""

TABLES["nation_wide"] = """
SELECT CAST(sum(late_orders) AS DOUBLE) / sum(delivered_orders) AS rate,
       sum(late_orders) AS late, sum(delivered_orders) AS delivered FROM q_states"""

TABLES["f_timestamp"] = """
SELECT round(100.0 * late / delivered, 6) AS late_rate_pct,
       round(100.0 * (late + (SELECT count(*) FROM clean_orders
                              WHERE delay_days = 0 AND estimated_ts < delivered_ts)) / delivered, 6)
           AS late_rate_pct_by_timestamp
FROM nation_wide"""

TABLES["ranked_states"] = """
SELECT *, row_number() OVER (ORDER BY late_rate_pct DESC, delivered_orders DESC, customer_state) AS place
FROM q_states WHERE enough_orders = 1"""

TABLES["f_worst"] = """
SELECT coalesce(string_agg(customer_state || ' (' || format('{:.1f}', late_rate_pct) || '%)', ', ' ORDER BY place),
                'none with enough orders') AS worst_states
FROM ranked_states WHERE place <= 3"""

TABLES["f_what_if"] = f"""
SELECT coalesce(string_agg(customer_state, ', ' ORDER BY place), 'none with enough orders')
           AS worst_state_codes,
       count(*) AS what_if_state_count,
       round(coalesce(sum(late_orders - rate * delivered_orders), 0), 6) AS late_orders_avoided,
       round(coalesce(sum(late_orders - rate * delivered_orders), 0)
             * ((SELECT low_review_pct FROM late_side) - (SELECT low_review_pct FROM on_time_side))
             / 100, 6) AS low_reviews_avoided
FROM ranked_states, nation_wide
WHERE place <= {PARAMS.worst_states_for_what_if} AND late_rate_pct / 100 > rate"""

TABLES["f_last"] = "SELECT max(purchase_month) AS last_full_month FROM q_monthly WHERE is_partial_month = 0"

TABLES["f_month1"] = """
SELECT round(100.0 * sum(CASE months_since_first WHEN 1 THEN active_customers ELSE 0 END)
             / greatest(sum(CASE months_since_first WHEN 0 THEN cohort_size ELSE 0 END), 1), 6)
           AS month1_retention_pct,
       count(CASE WHEN months_since_first = 0 THEN 1 END) AS month1_cohorts
FROM q_cohorts, f_last WHERE cohort_month < last_full_month"""

TABLES["f_uplift"] = """
SELECT round(aov, 6) AS avg_order_value, round(CAST(customers AS DOUBLE) * 0.01, 6) AS extra_repeat_customers_per_point,
       round(CAST(customers AS DOUBLE) * 0.01 * aov, 6) AS revenue_per_repeat_point,
       round(100.0 * repeat_customers_same_day_only / greatest(repeat_customers, 1), 6)
           AS repeat_same_day_only_pct
FROM q_repeat, (SELECT CAST(sum(revenue_delivered) AS DOUBLE) / sum(orders_delivered) AS aov FROM q_monthly)"""

TABLES["f_top3"] = """
SELECT string_agg(category, ', ' ORDER BY revenue DESC, category) AS top3_categories,
       round(sum(revenue_share_pct), 6) AS top3_revenue_share_pct
FROM (SELECT * FROM q_categories WHERE category <> 'unknown' ORDER BY revenue DESC, category LIMIT 3)"""

TABLES["freight_total"] = "SELECT CAST(freight AS DOUBLE) / revenue AS share, freight_share_pct FROM q_freight WHERE category = 'ALL CATEGORIES'"

TABLES["f_freight"] = """
SELECT coalesce(string_agg(category || ' (' || format('{:.1f}', freight_share_pct) || '%)', ', ' ORDER BY place),
                'none with enough orders') AS high_freight_categories,
       coalesce(string_agg(category, ', ' ORDER BY place), 'none with enough orders')
           AS high_freight_category_names,
       round(coalesce(sum(CAST(freight AS DOUBLE) - share * CAST(revenue AS DOUBLE)), 0), 6)
           AS freight_reduction
FROM (SELECT category, freight, revenue, freight_share_pct,
             row_number() OVER (ORDER BY freight_share_pct DESC, category) AS place
      FROM q_freight
      WHERE category NOT IN ('ALL CATEGORIES', 'unknown') AND enough_orders = 1),
     (SELECT share FROM freight_total)
WHERE place <= 5 AND freight_share_pct / 100 > share"""

_GRID = ",\n       ".join(
    f"""max(CASE WHEN datediff('month', cohort_month, last_full_month) >= {m}
            THEN coalesce((SELECT retention_pct FROM q_cohorts AS x
                           WHERE x.cohort_month = z.cohort_month AND x.months_since_first = {m}), 0)
            END) AS month_{m}"""
    for m in range(1, 7)
)
TABLES["f_grid"] = f"""
SELECT cohort_month,
       {_GRID}
FROM (SELECT * FROM q_cohorts WHERE months_since_first = 0
      AND cohort_size >= {PARAMS.min_cohort_size}) AS z, f_last
WHERE cohort_month < last_full_month GROUP BY cohort_month"""

SHOWN = {
    "review_gap_ci": "SELECT * FROM f_gap",
    "late_rate_by_timestamp": "SELECT * FROM f_timestamp",
    "worst_states": "SELECT * FROM f_worst",
    "worst_states_what_if": "SELECT * FROM f_what_if",
    "month1_retention": "SELECT * FROM f_month1",
    "repeat_uplift": "SELECT * FROM f_uplift",
    "top3_share": "SELECT * FROM f_top3",
    "freight_what_if": "SELECT * FROM f_freight",
    "cohort_grid": "SELECT * FROM f_grid",
    "last_full_month": "SELECT * FROM f_last",
    "revenue_trend_full_months": "SELECT purchase_month, revenue_delivered FROM q_monthly WHERE is_partial_month = 0",
    "late_rate_vs_national": """SELECT customer_state, late_rate_pct,
        round(100.0 * late / delivered, 6) AS national_late_rate_pct
        FROM q_states, nation_wide WHERE enough_orders = 1""",
    "top10_categories": "SELECT category, revenue FROM q_categories ORDER BY revenue DESC, category LIMIT 10",
    "monthly_trend_all_months": "SELECT purchase_month AS month, orders_placed AS value FROM q_monthly",
    "late_by_state_filtered": "SELECT * FROM q_states WHERE delivered_orders >= 170",
    "retention_curve": """SELECT cohort_month AS cohort, retention_pct, cohort_size, active_customers
        FROM q_cohorts WHERE months_since_first = 1""",
}
for _m in ("revenue_delivered", "orders_delivered", "orders_placed", "avg_order_value"):
    SHOWN[f"monthly_trend_{_m}"] = (
        f"SELECT purchase_month AS month, {_m} AS value FROM q_monthly WHERE is_partial_month = 0"
    )
_CATEGORY = "SELECT category, orders, revenue, revenue_share_pct, avg_review, reviewed_orders FROM q_categories"
SHOWN |= {
    "category_ranking_revenue": f"{_CATEGORY} WHERE enough_orders = 1 ORDER BY revenue DESC, category LIMIT 7",
    "category_ranking_highest_review": f"{_CATEGORY} WHERE enough_orders = 1 ORDER BY avg_review DESC, category LIMIT 7",
    "category_ranking_lowest_review": f"{_CATEGORY} WHERE enough_orders = 1 ORDER BY avg_review, category LIMIT 7",
    "category_ranking_all": f"{_CATEGORY} ORDER BY avg_review DESC, category LIMIT 12",
}

# --- the fact set: (fact, value, text) ---


def _whole(c: str) -> str:
    return f"format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT))"


def _percent(c: str) -> str:
    return f"format('{{:.1f}}', {c}) || '%'"


def _stars(c: str) -> str:
    return f"format('{{:.2f}}', {c})"


def _fact(name: str, text: str, source: str, value: str = "NULL") -> str:
    number = value if value == "NULL" else f"round(CAST({value} AS DOUBLE), 6)"
    return f"SELECT '{name}' AS fact, CAST({number} AS DOUBLE) AS value, {text} AS text FROM {source}"


def _both(name: str, spell, source: str, column: str | None = None) -> str:
    column = column or name
    return _fact(name, spell(f"CAST({column} AS DOUBLE)"), source, column)


_AFTER = "avg_review_late_answered_after_delivery"
_AFTER_COLUMN = "avg_review_answered_after_delivery"
FACTS = [
    _fact("data_label", f"'{LABEL}'", "(SELECT 1)"),
    _fact("generated_on", f"'{MADE_ON}'", "(SELECT 1)"),
    _fact("period_start", "strftime(min(purchase_month), '%b %Y')", "q_monthly"),
    _fact("period_end", "strftime(max(purchase_month), '%b %Y')", "q_monthly"),
    _fact(
        "partial_months",
        "coalesce(string_agg(CASE is_partial_month WHEN 1 THEN strftime(purchase_month, '%b %Y') END,"
        " ', ' ORDER BY purchase_month), 'none')",
        "q_monthly",
    ),
    _both("delivered_orders", _whole, "(SELECT sum(orders_delivered) AS delivered_orders FROM q_monthly)"),
    _both("revenue", _whole, "(SELECT sum(revenue_delivered) AS revenue FROM q_monthly)"),
    _both("avg_order_value", _whole, "f_uplift"),
    _fact(
        "dq_summary",
        "'Delivered without a delivery date: ' || "
        + _whole("sum(CASE WHEN is_delivered AND delivered_ts IS NULL THEN 1 ELSE 0 END)")
        + " || '; delivered before purchase: ' || "
        + _whole("sum(CASE WHEN is_delivered AND delivered_ts < purchase_ts THEN 1 ELSE 0 END)")
        + " || ' (neither is in the delay figures). Products without a category: ' || "
        + _whole("(SELECT count(*) FROM clean_products WHERE category_pt = 'unknown')")
        + " || '.'",
        "clean_orders",
    ),
    *[_both(n, _percent, "f_timestamp") for n in ("late_rate_pct", "late_rate_pct_by_timestamp")],
    *[_both(n, _stars, "f_gap") for n in ("review_gap", "review_gap_ci_low", "review_gap_ci_high")],
    _both("avg_review_late", _stars, "late_side", "avg_review"),
    _both("avg_review_on_time", _stars, "on_time_side", "avg_review"),
    _both("low_review_pct_late", _percent, "late_side", "low_review_pct"),
    _both("low_review_pct_on_time", _percent, "on_time_side", "low_review_pct"),
    _both("late_answered_before_delivery_pct", _percent, "late_side", "answered_before_delivery_pct"),
    _both("late_answered_after_delivery", _whole, "late_side", "answered_after_delivery"),
    _both(_AFTER, _stars, "late_side", _AFTER_COLUMN),
    _fact(
        "review_by_delay_buckets",
        "string_agg(delay_bucket || ' ' || format('{:.2f}', avg_review) || ' (n=' || "
        "format('{:,}', orders_with_review) || ')', '; ' ORDER BY delay_bucket_order)",
        "q_buckets",
    ),
    _fact("worst_states", "worst_states", "f_worst"),
    _fact("worst_state_codes", "worst_state_codes", "f_what_if"),
    *[
        _both(n, _whole, "f_what_if")
        for n in ("what_if_state_count", "late_orders_avoided", "low_reviews_avoided")
    ],
    _both("customers", _whole, "q_repeat"),
    _both("repeat_customers", _whole, "q_repeat"),
    _both("repeat_rate_pct", _percent, "q_repeat"),
    _both(
        "repeat_rate_by_customer_id",
        _percent,
        "q_repeat",
        "repeat_rate_pct_if_counted_by_customer_id",
    ),
    _both("median_days_to_second_order", _whole, "q_repeat", "median_days_first_to_second_order"),
    _both("repeat_same_day_only", _whole, "q_repeat", "repeat_customers_same_day_only"),
    _both("repeat_rate_later_day_pct", _percent, "q_repeat", "repeat_rate_pct_later_day"),
    _both("median_days_to_later_order", _whole, "q_repeat", "median_days_to_later_day_order"),
    _both("month1_retention_pct", _percent, "f_month1"),
    _both("month1_cohorts", _whole, "f_month1"),
    _both("repeat_same_day_only_pct", _percent, "f_uplift"),
    _both("extra_repeat_customers_per_point", _whole, "f_uplift"),
    _both("revenue_per_repeat_point", _whole, "f_uplift"),
    _fact("top3_categories", "top3_categories", "f_top3"),
    _both("top3_revenue_share_pct", _percent, "f_top3"),
    _both("freight_share_pct", _percent, "freight_total"),
    _fact("high_freight_categories", "high_freight_categories", "f_freight"),
    _fact("high_freight_category_names", "high_freight_category_names", "f_freight"),
    _both("freight_reduction", _whole, "f_freight"),
]
TABLES["fact_texts"] = "\nUNION ALL\n".join(FACTS)
SHOWN["memo_facts"] = "SELECT * FROM fact_texts"
SHOWN["whole_batch"] = "SELECT * FROM fact_texts"
