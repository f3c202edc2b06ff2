"""The table graph: raw text -> typed tables -> star schema -> answers, one builder for each."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.functions.ordering import with_marks
from marketspark.operators import clean, model
from marketspark.operators.clean import BRAZIL, Box
from marketspark.operators.quality import counted_on_write, quality_log
from marketspark.params import Params
from marketspark.plans.facts import QUOTED_CHECKS, memo_facts
from marketspark.plans.questions import ORDERS_ALONE, ORDERS_WITH, QUESTIONS, basket_size, category_orders, months_placed, seller_stats
from marketspark.sources.store import Lake

Builder = Callable[[Lake], DataFrame]


def _marks_if_few(t: Lake) -> DataFrame | None:
    """Digests of payment lines that may have copies; none if they are too many to broadcast."""
    marks = t.few("payment_marks")
    return marks if t.is_few("payment_marks") else None


CLEAN: dict[str, Builder] = {
    "clean_customers": lambda t: clean.clean_customers(t["raw_customers"]),
    "clean_sellers": lambda t: clean.clean_sellers(t["raw_sellers"]),
    "clean_products": lambda t: clean.clean_products(
        t["raw_products"], t["raw_category_translation"]
    ),
    "clean_orders": lambda t: clean.clean_orders(t["raw_orders"]),
    "clean_order_items": lambda t: clean.clean_order_items(t["raw_order_items"], t.few("crowded_orders")),
    "clean_payments": lambda t: clean.clean_payments(t["raw_payments"], _marks_if_few(t)),
    "clean_reviews": lambda t: clean.clean_reviews(t["raw_reviews"]),
    "clean_state_centroids": lambda t: clean.clean_state_centroids(t["raw_geolocation"], t.box),
}


def _orders_alone(t: Lake) -> str:
    """The table of orders for whoever needs no sums of lines: the fact if it is there, else one that is
    made without lines and payments."""
    return "fact_orders" if t.ready("fact_orders") else "order_columns"


def orders_with(t: Lake, *columns: str) -> DataFrame:
    """Some columns of the fact of orders: from the fact if it is there, else from the tables that they need."""
    if t.ready("fact_orders"):
        return t["fact_orders"].select(*columns)
    parts = model.parts_of(columns)
    names = {"orders": "clean_orders"} | {part: f"clean_{part}" for part in parts if part != "items"}
    if "payments" in parts:
        names["kinds"] = "payment_kinds"
    if "items" in parts:
        t.together(*names.values(), *LINES)
        return model.orders_with(columns, **t.pick_as(names), items=list(lines_by_order(t).values()))
    return model.orders_with(columns, **t.pick_as(names))


def lines_by_order(t: Lake) -> dict[str, DataFrame]:
    """The tables that make up the cleaned lines, each order in one of them: the calm ones lie in buckets by order."""
    known = t.seen.get("crowded_orders", {}).get("rows")
    t.together(*LINES)
    return {name: t[name] for name in LINES if name != "crowded_order_items" or known != 0}


def _fact_orders(t: Lake) -> DataFrame:
    names = {part: f"clean_{part}" for part in ("orders", "customers", "payments", "reviews")} | {"kinds": "payment_kinds"}
    t.together(*names.values(), *LINES)
    return model.fact_orders(**t.pick_as(names), items=list(lines_by_order(t).values()))


def _all_lines(t: Lake) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.plain(name) for name in lines_by_order(t)])


def _fact_order_items(t: Lake) -> DataFrame:
    """Each table of lines meets the orders by itself, so the calm ones stay where they lie; few orders are crowded."""
    orders, products, sellers, *_ = t.together(_orders_alone(t), "clean_products", "clean_sellers", *LINES)
    met = []
    for name, lines in lines_by_order(t).items():
        some = orders if name == "calm_order_items" else with_marks(orders, "order_id", t.few("crowded_orders"))
        met.append(model.lines_of_orders(lines, some))
    return model.with_lookups(reduce(DataFrame.unionByName, met), products, sellers)


#: Cleaned lines of orders with few and with very many of them.
LINES: dict[str, Builder] = {
    "calm_order_items": lambda t: clean.calm_order_items(t["raw_order_items"], t.few("crowded_orders")),
    "crowded_order_items": lambda t: clean.crowded_order_items(t["raw_order_items"], t.few("crowded_orders")),
}
#: Digests that others are made with: orders with very many lines, payment lines that may have copies.
MARKS: dict[str, Builder] = {
    "crowded_orders": lambda t: clean.crowded_orders(t["raw_order_items"]),
    "payment_marks": lambda t: clean.payment_marks(t["raw_payments"]),
}
LOOKUPS: dict[str, Builder] = {
    "payment_kinds": lambda t: model.payment_kinds(t["clean_payments"]),
    "basket_orders": lambda t: orders_with(t, *ORDERS_WITH[basket_size]),  # read twice, for the median
    "order_columns": lambda t: model.order_columns(
        *t.together("clean_orders", "clean_customers", "clean_reviews")
    ),
}
MODEL: dict[str, Builder] = {
    "fact_orders": _fact_orders,
    "fact_order_items": _fact_order_items,
    "fact_payments": lambda t: model.fact_payments(*t.together("clean_payments", _orders_alone(t))),
    "dim_customer": lambda t: model.dim_customer(t[_orders_alone(t)]),
    "dim_product": lambda t: model.dim_product(t["clean_products"]),
    "dim_seller": lambda t: model.dim_seller(t["clean_sellers"]),
    "dim_state": lambda t: model.dim_state(t["states"], t["clean_state_centroids"]),
    "dim_date": lambda t: model.dim_date(orders_with(t, "purchase_date")),
}



def _months_placed(t: Lake) -> DataFrame:
    answer = "monthly_orders_revenue"
    if t.ready(answer):
        return t[answer].select("purchase_month", "orders_placed", "is_partial_month")
    return months_placed({"fact_orders": orders_with(t, "purchase_month")})


def _category_orders(t: Lake) -> DataFrame:
    if t.ready("fact_order_items"):
        return category_orders({"fact_order_items": t["fact_order_items"]})
    columns = ("order_id", "is_delivered", "review_score")
    lines, products = t.together("clean_order_items", "clean_products")
    orders = t["order_columns"].select(*columns) if t.ready("order_columns") else orders_with(t, *columns)
    return category_orders({"fact_order_items": model.lines_with_category(lines, orders, products)})


SUMMARIES: dict[str, Builder] = {
    "seller_stats": seller_stats,
    "months_placed": _months_placed,
    "category_orders": _category_orders,
}


def _orders_for(t: Lake, question: Callable) -> Mapping[str, DataFrame]:
    """The tables of a question: only the columns of orders that it reads, if it says so."""
    if question in ORDERS_ALONE:
        return {"fact_orders": t[_orders_alone(t)]}
    if question is basket_size and not t.ready("fact_orders"):
        return {"fact_orders": t["basket_orders"]}
    if question in ORDERS_WITH:
        return {"fact_orders": orders_with(t, *ORDERS_WITH[question])}
    return t


ANSWERS: dict[str, Builder] = {
    q.answer.__name__: (lambda t, q=q: q.answer(_orders_for(t, q.answer), t.params)) for q in QUESTIONS
}


def _quoted_checks(t: Lake) -> DataFrame:
    """The checks that facts quote: lines of the log if it is there, else these checks alone."""
    return t["dq_log"].filter(F.col("check").isin(*QUOTED_CHECKS)) if t.ready("dq_log") else quality_log(t, QUOTED_CHECKS, t.box)


def _memo_facts(t: Lake) -> DataFrame:
    t.together("quoted_checks", *FACT_ANSWERS)
    return memo_facts(t, t["quoted_checks"], t.params, t.label, t.made_on)


#: The answers that facts quote.
FACT_ANSWERS = (
    "monthly_orders_revenue",
    "repeat_customer_rate",
    "top_categories",
    "late_delivery_by_state",
    "review_late_vs_on_time",
    "freight_share",
    "cohort_retention",
    "review_by_delay_bucket",
)
REPORTS: dict[str, Builder] = {
    "dq_log": lambda t: quality_log(t, box=t.box),
    "quoted_checks": _quoted_checks,
    "memo_facts": _memo_facts,
}


class Warehouse(Lake):
    """Every table of one input by name. Typed tables, the star schema, the answers and the reports
    are each written once, on first use; raw tables stay plans over their files unless `store_raw`
    asks for a columnar copy (worth it for CSV, which is slow to read twice).

    With stored=False every table is a lazy plan: for small inputs, and for reading whole plans.
    """

    def __init__(
        self,
        spark: SparkSession,
        raw: dict[str, DataFrame],
        params: Params,
        states: DataFrame | None = None,
        box: Box = BRAZIL,
        folder: str | None = None,
        stored: bool = True,
        store_raw: bool = False,
        label: str = "",
        made_on: datetime.date | None = None,
        buckets: int | None = None,
    ):
        self.box = box
        self.label = label
        self.made_on = made_on
        self.params = params
        self.raw_names = tuple(raw)
        given = {f"raw_{name}": df for name, df in raw.items()}
        given["states"] = model.brazil_states(spark) if states is None else states
        plans = {name: (lambda lake, df=df: df) for name, df in given.items()}
        builders = plans | MARKS | CLEAN | LINES | LOOKUPS | MODEL | SUMMARIES | ANSWERS | REPORTS
        builders["clean_order_items"] = _all_lines
        if not stored:
            views = frozenset(builders)
        else:
            views = frozenset({"clean_order_items", *({"states"} if store_raw else plans)})
        counts = counted_on_write(box) | {name: {"rows": F.count(F.lit(1))} for name in MARKS}
        for name in (f"raw_{n}" for n in raw):
            counts[name] = counts.get(name, {}) | {"rows": F.count(F.lit(1))}
        super().__init__(spark, builders, views, folder, buckets, counts)

    def raw(self) -> dict[str, DataFrame]:
        frames = self.together(*[f"raw_{name}" for name in self.raw_names])
        return dict(zip(self.raw_names, frames, strict=True))

    def rows_written(self) -> dict[str, int]:
        """Rows of the raw tables that were stored, counted on the way."""
        self.raw()
        return {name: self.seen[f"raw_{name}"]["rows"] for name in self.raw_names if f"raw_{name}" in self.seen}

    def model(self) -> dict[str, DataFrame]:
        self["fact_orders"]  # the other facts read it once it is there
        return self.pick(*MODEL)

    def answers(self) -> dict[str, DataFrame]:
        self["fact_orders"]
        return self.pick(*ANSWERS)


def build_model(
    spark: SparkSession,
    raw: dict[str, DataFrame],
    states: DataFrame | None = None,
    box: Box = BRAZIL,
    stored: bool = True,
) -> dict[str, DataFrame]:
    """The star schema from the raw tables; each table is written once, so later ones read it.

    With stored=False all tables are lazy plans, and each plan holds the ones below it again.
    """
    return Warehouse(spark, raw, Params(), states, box, stored=stored).model()
