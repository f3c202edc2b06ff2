"""Independent DuckDB SQL for every query: the correctness twin of the Spark jobs."""

from oracle import facts, measures, quality, text
from oracle.questions import QUESTIONS
from oracle.tables import with_tables

STORED = (
    "clean_customers",
    "clean_sellers",
    "clean_products",
    "clean_orders",
    "clean_order_items",
    "clean_payments",
    "clean_reviews",
    "clean_state_centroids",
    "fact_orders",
    "fact_order_items",
    "fact_payments",
    "dim_customer",
    "dim_product",
    "dim_seller",
    "dim_state",
    "dim_date",
)

PLAIN: dict[str, str] = {name: f"SELECT * FROM {name}" for name in STORED}
PLAIN |= QUESTIONS | facts.SHOWN | measures.SHOWN | text.SHOWN
PLAIN["dq_log"] = quality.LOG
PLAIN |= {f"dq_{name}": sql for name, sql in quality.LINES.items()}

ORACLES = {name: with_tables(sql) for name, sql in PLAIN.items()}
