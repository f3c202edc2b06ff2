"""A small semantic layer: named measures over the star schema, sliced by dimension attributes.

Every measure is a formula over sums, so the fact table is first summed by its own columns and
foreign keys and only that result meets a dimension. A hot state, seller or day is folded by
map-side aggregation before any shuffle, and no fact row is ever joined.

Attributes are written `table.column`. A filter on a table that is not related to the measure's
fact has no effect on it, as in a star-schema filter context; a table that the model lacks is an error.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.columns import ratio

Model = Mapping[str, DataFrame]
Where = Mapping[str, Sequence]

#: fact -> dimension -> (foreign key on the fact, key of the dimension)
RELATIONS = {
    "fact_orders": {
        "dim_date": ("purchase_date", "date"),
        "dim_state": ("customer_state", "state_code"),
        "dim_customer": ("customer_unique_id", "customer_unique_id"),
    },
    "fact_order_items": {
        "dim_date": ("purchase_date", "date"),
        "dim_state": ("customer_state", "state_code"),
        "dim_customer": ("customer_unique_id", "customer_unique_id"),
        "dim_product": ("product_id", "product_id"),
        "dim_seller": ("seller_id", "seller_id"),
    },
    "fact_payments": {
        "dim_date": ("purchase_date", "date"),
        "dim_state": ("customer_state", "state_code"),
    },
    "dim_customer": {},
}


Part = Callable[[], Column]


@dataclass(frozen=True)
class Measure:
    """`value` combines the sums named in `parts`; `rows` and `once_per` narrow the fact first."""

    table: str
    parts: tuple[Part, ...]
    value: Callable[..., Column]
    rows: str | None = None
    once_per: tuple[str, ...] = ()


def _n(condition: str) -> Part:
    return lambda: F.count_if(F.expr(condition))


def _sum(column: str, condition: str = "true") -> Part:
    return lambda: F.sum(F.when(F.expr(condition), F.col(column)))


def _have(column: str, condition: str) -> Part:
    return lambda: F.count(F.when(F.expr(condition), F.col(column)))


def _one(table: str, part: Part) -> Measure:
    return Measure(table, (part,), lambda a: a)


def _quotient(table: str, a: Part, b: Part, **more) -> Measure:
    return Measure(table, (a, b), ratio, **more)


_DONE = "is_delivered = 1"
_DATED = "has_valid_delivery = 1"
_REVIEWED = f"{_DONE} and review_score is not null"

MEASURES: dict[str, Measure] = {
    "orders_placed": _one("fact_orders", _n("true")),
    "delivered_orders": _one("fact_orders", _n(_DONE)),
    "revenue": _one("fact_orders", _sum("item_revenue", _DONE)),
    "average_order_value": _quotient("fact_orders", _sum("item_revenue", _DONE), _n(_DONE)),
    "item_revenue": _one("fact_order_items", _sum("price", _DONE)),
    "freight_share": _quotient(
        "fact_order_items", _sum("freight_value", _DONE), _sum("price", _DONE)
    ),
    "payment_value": _one("fact_payments", _sum("payment_value", _DONE)),
    "customers": _one("dim_customer", _n("delivered_orders >= 1")),
    "repeat_customers": _one("dim_customer", _n("is_repeat_customer = 1")),
    "repeat_rate": _quotient(
        "dim_customer", _n("is_repeat_customer = 1"), _n("delivered_orders >= 1")
    ),
    "orders_with_delivery_date": _one("fact_orders", _n(_DATED)),
    "late_orders": _one("fact_orders", _n("is_late = 1")),
    "late_rate": _quotient("fact_orders", _n("is_late = 1"), _n(_DATED)),
    "avg_delivery_days": _quotient(
        "fact_orders", _sum("delivery_days", _DATED), _have("delivery_days", _DATED)
    ),
    "avg_review_score": _quotient(
        "fact_orders", _sum("review_score", _DONE), _have("review_score", _DONE)
    ),
    "low_review_share": _quotient(
        "fact_orders", _n(f"{_REVIEWED} and review_score <= 2"), _n(_REVIEWED)
    ),
    "answered_before_delivery_share": _quotient(
        "fact_orders",
        _n("review_answered_before_delivery = 1 and review_score is not null"),
        _n(f"{_DATED} and review_score is not null"),
    ),
    "avg_review_orders_in_category": _quotient(
        "fact_order_items",
        _sum("review_score"),
        _have("review_score", "true"),
        rows=_REVIEWED,
        once_per=("order_id", "review_score"),
    ),
}


def _split(attribute: str) -> tuple[str, str]:
    table, _, column = attribute.partition(".")
    if not column:
        raise ValueError(f"write the attribute as table.column: {attribute!r}")
    return table, column


def _within_months(fact: DataFrame, days: DataFrame) -> DataFrame:
    """Read only the month partitions that hold a wanted day.

    The list has one row for each calendar month, so it is small enough to broadcast, and Spark
    prunes the partitions of the fact with it before reading them.
    """
    months = days.select(F.col("month_start").alias("_month")).distinct()
    return fact.join(F.broadcast(months), F.col("purchase_month") == F.col("_month"), "left_semi")


def measures(
    model: Model, names: Sequence[str], by: Sequence[str] = (), where: Where | None = None
) -> DataFrame:
    """Measures of one fact, in one pass, for each combination of the `by` attributes.

    Returns the bare attribute columns and one value column for each measure.
    """
    chosen = {name: MEASURES[name] for name in names}
    grains = {(m.table, m.rows, m.once_per) for m in chosen.values()}
    if len(grains) != 1:
        raise ValueError(f"measures of different grains cannot share a pass: {list(names)}")
    ((fact_name, rows, once_per),) = grains
    related = RELATIONS[fact_name]
    by_columns = [_split(a) for a in by]
    for table, column in by_columns:
        if table != fact_name and table not in related:
            raise ValueError(f"{fact_name} has no relation to {table}.{column}")
    filters: dict[str, Column] = {}
    known = set(RELATIONS).union(*RELATIONS.values())
    for attribute, values in (where or {}).items():
        table, column = _split(attribute)
        if table not in known:
            raise ValueError(f"the model has no table {table}: {attribute!r}")
        condition = F.col(column).isin(*values)
        filters[table] = filters[table] & condition if table in filters else condition

    fact = model[fact_name]
    if rows:
        fact = fact.filter(rows)
    if fact_name in filters:
        fact = fact.filter(filters[fact_name])
    if "dim_date" in filters and "dim_date" in related:
        fact = _within_months(fact, model["dim_date"].filter(filters["dim_date"]))
    dims = [d for d in related if d in filters or any(t == d for t, _ in by_columns)]
    own = [c for t, c in by_columns if t == fact_name]
    keys = dict.fromkeys([*own, *[related[d][0] for d in dims], *once_per])
    parts = {
        f"{name}_{i}": part for name, m in chosen.items() for i, part in enumerate(m.parts)
    }

    # Sums for each key (or the distinct rows to count once), before any dimension is joined.
    keyed = fact.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys])
    if once_per:
        small = keyed.agg(F.lit(1).alias("_"))
    else:
        small = keyed.agg(*[part().alias(p) for p, part in parts.items()])
    for dim in dims:
        foreign, key = related[dim]
        attributes = [c for t, c in by_columns if t == dim]
        side = model[dim].filter(filters[dim]) if dim in filters else model[dim]
        side = side.select(
            F.col(key).alias(f"_{dim}"), *[F.col(c).alias(f"{dim}_{c}") for c in attributes]
        )
        how = "inner" if dim in filters else "left"
        small = small.join(side, F.col(f"k_{foreign}") == F.col(f"_{dim}"), how)

    groups = [F.col(f"k_{c}" if t == fact_name else f"{t}_{c}").alias(c) for t, c in by_columns]
    columns = [c for _, c in by_columns]
    if once_per:
        single = small.select(*groups, *[F.col(f"k_{c}").alias(c) for c in once_per]).distinct()
        totals = single.groupBy(*columns).agg(*[part().alias(p) for p, part in parts.items()])
    else:
        totals = small.groupBy(*groups).agg(*[F.sum(p).alias(p) for p in parts])
    values = [
        m.value(*[F.col(f"{name}_{i}") for i in range(len(m.parts))]).alias(name)
        for name, m in chosen.items()
    ]
    return totals.select(*columns, *values)


def measure(
    model: Model, name: str, by: Sequence[str] = (), where: Where | None = None
) -> DataFrame:
    return measures(model, [name], by, where)


def _with_months_before(model: Model, where: Where) -> Model:
    """The model with only those months of the revenue fact that hold a wanted day, or precede one."""
    days = model["dim_date"]
    for attribute, values in where.items():
        table, column = _split(attribute)
        if table == "dim_date":
            days = days.filter(F.col(column).isin(*values))
    earlier = days.select(F.add_months("month_start", -1).alias("month_start"))
    fact = MEASURES["revenue"].table
    return ChainMap({fact: _within_months(model[fact], days.select("month_start").union(earlier))}, model)


def revenue_mom(model: Model, by: Sequence[str] = (), where: Where | None = None) -> DataFrame:
    """Revenue growth over the previous calendar month; NULL where that month has no revenue.

    The previous month is looked up beyond the date filters, within all the others. The fact is read once, in
    the months that are wanted or precede one: each day's sum goes to its own month if the day is wanted, and to the next
    month as that of the month before.
    """
    where = where or {}
    dates = {a: v for a, v in where.items() if _split(a)[0] == "dim_date"}
    others = {a: v for a, v in where.items() if a not in dates}
    columns = [_split(a)[1] for a in by]
    fact = MEASURES["revenue"].table
    day = "purchase_date"
    attributes = dict.fromkeys(["dim_date.month_start", f"{fact}.{day}", *by])
    daily = measure(_with_months_before(model, where) if dates else model, "revenue", list(attributes), others)
    days = model["dim_date"]
    for attribute, values in dates.items():
        days = days.filter(F.col(_split(attribute)[1]).isin(*values))
    wanted = days.select(F.col("date").alias("_day"), F.lit(True).alias("_wanted"))
    known = daily.join(wanted, F.col(day) == F.col("_day"), "left").filter(F.col("month_start").isNotNull())
    none = F.lit(None).cast(dict(daily.dtypes)["revenue"])
    is_wanted = F.coalesce("_wanted", F.lit(False))
    sides = F.array(
        F.struct(
            F.col("month_start").alias("_month"), F.when(is_wanted, F.col("revenue")).alias("_now"), none.alias("_before"), is_wanted.alias("_own")
        ),
        F.struct(F.add_months("month_start", 1).alias("_month"), none.alias("_now"), F.col("revenue").alias("_before"), F.lit(False).alias("_own")),
    )
    spread = known.select(*[F.col(c) for c in columns], F.inline(sides))
    now, before = F.sum("_now"), F.sum("_before")
    grown = spread.groupBy(F.col("_month").alias("month_start"), *columns).agg(
        F.max("_own").alias("_own"), ratio(now - before, before).alias("revenue_mom")
    )
    return grown.filter("_own").select("month_start", *columns, "revenue_mom")


# --- page queries ---


def revenue_by_state(model: Model, where: Where | None = None) -> DataFrame:
    return measure(model, "revenue", ["dim_state.state_name"], where)


def top_categories_by_item_revenue(model: Model, n: int = 10) -> DataFrame:
    rows = measure(model, "item_revenue", ["fact_order_items.category"])
    return rows.orderBy(F.desc_nulls_last("item_revenue"), "category").limit(n)


def payment_mix(model: Model, where: Where | None = None) -> DataFrame:
    return measure(model, "payment_value", ["fact_payments.payment_type"], where)


def cohort_matrix(retention: DataFrame, min_cohort_size: int, months: int = 6) -> DataFrame:
    cells = retention.filter(
        (F.col("cohort_size") >= min_cohort_size) & F.col("months_since_first").between(1, months)
    )
    return (
        cells.groupBy("cohort_month")
        .pivot("months_since_first", list(range(1, months + 1)))
        .agg(F.sum("retention_pct"))
        .withColumnsRenamed({str(m): f"month_{m}" for m in range(1, months + 1)})
    )


def orders_per_customer(model: Model) -> DataFrame:
    return model["dim_customer"].groupBy("delivered_orders").agg(
        F.count(F.lit(1)).alias("customers")
    )


def experience_by_delay(model: Model, where: Where | None = None) -> DataFrame:
    """Review score, low-review share and answered-before share of each delay band."""
    band = ["fact_orders.delay_bucket"]
    names = ["avg_review_score", "low_review_share", "answered_before_delivery_share"]
    return measures(model, names, band, where).filter(F.col("delay_bucket").isNotNull())


def late_rate_by_state(model: Model, min_orders: int, where: Where | None = None) -> DataFrame:
    names = ["late_rate", "orders_with_delivery_date"]
    rates = measures(model, names, ["dim_state.state_code"], where)
    return rates.filter(F.col("orders_with_delivery_date") >= min_orders)


def revenue_by_weekday(model: Model, where: Where | None = None) -> DataFrame:
    return measure(model, "revenue", ["dim_date.weekday_number", "dim_date.weekday_name"], where)
