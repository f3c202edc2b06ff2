"""Decision facts: small post-aggregations over the stored answers, never over the facts tables.

`answers` maps a question's function name to its answer. Missing groups give NULL values, not
errors. Published figures use the rounded answers, so these do as well.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.columns import (
    pct,
    ratio,
    rounded,
    text_int,
    text_month,
    text_pct,
    text_two,
)
from marketspark.operators.clean import UNKNOWN
from marketspark.params import Params
from marketspark.plans.questions import ALL_CATEGORIES

Answers = Mapping[str, DataFrame]

Z_95 = 1.96
GRID_MONTHS = 6
NONE_LISTED = "none with enough orders"
NOT_AVAILABLE = "n/a"


def _top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows with their place: a bounded top-k, then a number on the k rows."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return df.orderBy(*order).limit(n).withColumn("_place", place)


def _listed(text: Column, when_empty: str = NONE_LISTED, sep: str = ", ") -> Column:
    """Join the texts of a few rows in the order of `_place`."""
    items = F.array_sort(F.collect_list(F.struct("_place", text.alias("t"))))
    joined = F.array_join(F.transform(items, lambda x: x["t"]), sep)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(when_empty))


def _six(c: Column) -> Column:
    return rounded(c, 6)


def _pick(column: str, group: str) -> Column:
    return F.max(F.when(F.col("delivery_group") == group, F.col(column)))


# --- single figures ---


def last_full_month(answers: Answers) -> DataFrame:
    """The latest month that is not partial."""
    # A warehouse tells months apart without their revenue.
    months = answers["months_placed" if "months_placed" in answers else "monthly_orders_revenue"]
    full = months.filter("is_partial_month = 0")
    return full.agg(F.max("purchase_month").alias("last_full_month"))


def review_gap_ci(answers: Answers) -> DataFrame:
    """On-time minus late mean score with a 95% interval (normal approximation)."""
    sides = answers["review_late_vs_on_time"].agg(
        *[
            _pick(column, group).alias(f"{group}_{name}")
            for group in ("on_time", "late")
            for name, column in (
                ("avg", "avg_review"),
                ("sd", "sd_review"),
                ("n", "orders_with_review"),
            )
        ]
    )
    gap = F.col("on_time_avg") - F.col("late_avg")
    error = F.sqrt(
        F.col("on_time_sd") * F.col("on_time_sd") / F.col("on_time_n")
        + F.col("late_sd") * F.col("late_sd") / F.col("late_n")
    )
    return sides.select(
        _six(gap).alias("review_gap"),
        _six(gap - error * Z_95).alias("review_gap_ci_low"),
        _six(gap + error * Z_95).alias("review_gap_ci_high"),
    )


def late_rate_by_timestamp(answers: Answers, dq_log: DataFrame) -> DataFrame:
    """The late rate if clock times were compared instead of dates."""
    extra = dq_log.filter(
        F.col("check") == "orders_on_time_by_date_but_late_by_timestamp"
    ).agg(F.sum("rows_affected"))
    n = F.sum("delivered_orders")
    return (
        answers["late_delivery_by_state"]
        .agg(F.sum("late_orders").alias("late"), n.alias("delivered"))
        .select(
            _six(pct(F.col("late"), F.col("delivered"))).alias("late_rate_pct"),
            _six(pct(F.col("late") + extra.scalar(), F.col("delivered"))).alias(
                "late_rate_pct_by_timestamp"
            ),
        )
    )


def _national_rate(answers: Answers) -> DataFrame:
    return answers["late_delivery_by_state"].agg(
        ratio(F.sum("late_orders"), F.sum("delivered_orders"))
    )


def _worst_states(answers: Answers, n: int) -> DataFrame:
    states = answers["late_delivery_by_state"].filter("enough_orders = 1")
    return _top(
        states,
        n,
        F.col("late_rate_pct").desc_nulls_last(),
        F.col("delivered_orders").desc(),
        F.col("customer_state").asc_nulls_last(),
    )


def worst_states(answers: Answers, shown: int = 3) -> DataFrame:
    named = F.concat("customer_state", F.lit(" ("), text_pct(F.col("late_rate_pct")), F.lit(")"))
    return _worst_states(answers, shown).agg(_listed(named).alias("worst_states"))


def worst_states_what_if(answers: Answers, params: Params) -> DataFrame:
    """Late orders and low reviews avoided if the worst states were as punctual as all states."""
    chosen = (
        _worst_states(answers, params.worst_states_for_what_if)
        .withColumn("_national", _national_rate(answers).scalar())
        .filter(F.col("late_rate_pct") / 100 > F.col("_national"))
    )
    excess = F.col("late_orders") - F.col("_national") * F.col("delivered_orders")
    low_gap = answers["review_late_vs_on_time"].agg(
        F.coalesce(_pick("low_review_pct", "late"), F.lit(0.0)) - _pick("low_review_pct", "on_time")
    )
    return chosen.agg(
        _listed(F.col("customer_state")).alias("worst_state_codes"),
        F.count(F.lit(1)).alias("what_if_state_count"),
        F.coalesce(F.sum(excess), F.lit(0.0)).alias("late_orders_avoided"),
    ).select(
        "worst_state_codes",
        "what_if_state_count",
        _six(F.col("late_orders_avoided")).alias("late_orders_avoided"),
        _six(F.col("late_orders_avoided") * low_gap.scalar() / 100).alias("low_reviews_avoided"),
    )


def month1_retention(answers: Answers) -> DataFrame:
    """Share of customers back one month later, over cohorts whose next month is a full one."""
    cohorts = answers["cohort_retention"].filter(
        F.col("cohort_month") < last_full_month(answers).scalar()
    )
    at = F.col("months_since_first")
    size = F.coalesce(F.sum(F.when(at == 0, F.col("cohort_size"))), F.lit(0))
    back = F.coalesce(F.sum(F.when(at == 1, F.col("active_customers"))), F.lit(0))
    return cohorts.agg(
        _six(pct(back, F.greatest(size, F.lit(1)))).alias("month1_retention_pct"),
        F.count_if(at == 0).alias("month1_cohorts"),
    )


def repeat_uplift(answers: Answers) -> DataFrame:
    """What one more point of repeat rate is worth at today's average order value."""
    value = answers["monthly_orders_revenue"].agg(
        ratio(F.sum("revenue_delivered"), F.sum("orders_delivered"))
    )
    extra = F.col("customers") * 0.01
    same_day = F.col("repeat_customers_same_day_only")
    return answers["repeat_customer_rate"].withColumn("_aov", value.scalar()).select(
        _six(F.col("_aov")).alias("avg_order_value"),
        _six(extra).alias("extra_repeat_customers_per_point"),
        _six(extra * F.col("_aov")).alias("revenue_per_repeat_point"),
        _six(pct(same_day, F.greatest("repeat_customers", F.lit(1)))).alias(
            "repeat_same_day_only_pct"
        ),
    )


def top3_share(answers: Answers) -> DataFrame:
    """The three named categories with most revenue, and their share together."""
    named = answers["top_categories"].filter(F.col("category") != UNKNOWN)
    top = _top(named, 3, F.col("revenue").desc_nulls_last(), F.col("category"))
    return top.agg(
        _listed(F.col("category")).alias("top3_categories"),
        _six(F.coalesce(F.sum("revenue_share_pct"), F.lit(0.0))).alias("top3_revenue_share_pct"),
    )


def freight_what_if(answers: Answers, shown: int = 5) -> DataFrame:
    """Freight saved if the freight-heavy categories came down to the overall share."""
    freight = answers["freight_share"]
    overall = freight.filter(F.col("category") == ALL_CATEGORIES).agg(
        F.max(ratio(F.col("freight"), F.col("revenue")))
    )
    named = freight.filter(
        ~F.col("category").isin(ALL_CATEGORIES, UNKNOWN) & (F.col("enough_orders") == 1)
    )
    heavy = (
        _top(named, shown, F.col("freight_share_pct").desc_nulls_last(), F.col("category"))
        .withColumn("_overall", overall.scalar())
        .filter(F.col("freight_share_pct") / 100 > F.col("_overall"))
    )
    excess = F.col("freight").cast("double") - F.col("_overall") * F.col("revenue").cast("double")
    with_share = F.concat("category", F.lit(" ("), text_pct(F.col("freight_share_pct")), F.lit(")"))
    return heavy.agg(
        _listed(with_share).alias("high_freight_categories"),
        _listed(F.col("category")).alias("high_freight_category_names"),
        _six(F.coalesce(F.sum(excess), F.lit(0.0))).alias("freight_reduction"),
    )


# --- data behind the charts ---


def cohort_grid(answers: Answers, params: Params, months: int = GRID_MONTHS) -> DataFrame:
    """Retention by cohort for months 1..n: 0 where nobody came back, NULL where not yet observable.

    Cohorts that are too small, or with no observable month at all, are left out.
    """
    observed = answers["cohort_retention"]
    last = last_full_month(answers).scalar()
    sizes = observed.filter(
        (F.col("months_since_first") == 0) & (F.col("cohort_size") >= params.min_cohort_size)
    ).select("cohort_month", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("m"))
    seen = observed.select("cohort_month", F.col("months_since_first").alias("m"), "retention_pct")
    cells = (
        sizes.withColumn("_last", last)
        .filter(F.add_months("cohort_month", F.col("m")) <= F.col("_last"))
        .join(seen, ["cohort_month", "m"], "left")
        .withColumn("value", F.coalesce("retention_pct", F.lit(0.0)))
    )
    return (
        cells.groupBy("cohort_month")
        .pivot("m", list(range(1, months + 1)))
        .agg(F.max("value"))
        .withColumnsRenamed({str(m): f"month_{m}" for m in range(1, months + 1)})
        .orderBy("cohort_month")
    )


def revenue_trend_full_months(answers: Answers) -> DataFrame:
    full = answers["monthly_orders_revenue"].filter("is_partial_month = 0")
    return full.select("purchase_month", "revenue_delivered").orderBy("purchase_month")


def late_rate_vs_national(answers: Answers) -> DataFrame:
    states = answers["late_delivery_by_state"]
    national = states.agg(_six(pct(F.sum("late_orders"), F.sum("delivered_orders"))))
    return (
        states.filter("enough_orders = 1")
        .select("customer_state", "late_rate_pct")
        .withColumn("national_late_rate_pct", national.scalar())
        .orderBy("late_rate_pct", F.col("customer_state").asc_nulls_last())
    )


def top10_categories(answers: Answers) -> DataFrame:
    order = F.col("revenue").desc_nulls_last(), F.col("category")
    return answers["top_categories"].select("category", "revenue").orderBy(*order).limit(10)


# --- the whole fact set ---

Line = tuple[str, Column | None, Column]


def _lines(frame: DataFrame, lines: list[Line]) -> DataFrame:
    """One row of figures to (fact, value, text) rows."""
    number = F.lit(None).cast("double")
    return frame.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("fact"),
                        (number if value is None else _six(value)).alias("value"),
                        text.alias("text"),
                    )
                    for name, value, text in lines
                ]
            )
        )
    )


def _number(name: str, text, column: str | None = None) -> Line:
    value = F.col(column or name)
    return name, value, text(value)


def _label(name: str) -> Line:
    return name, None, F.col(name)


def _or_na(text: Column) -> Column:
    return F.coalesce(text, F.lit(NOT_AVAILABLE))


def overview_facts(answers: Answers, label: str, made_on: Column) -> DataFrame:
    month = F.col("purchase_month")
    partial = F.col("is_partial_month") == 1
    months = F.array_sort(F.collect_list(F.when(partial, month)))
    frame = answers["monthly_orders_revenue"].agg(
        F.lit(label).alias("data_label"),
        F.date_format(made_on, "yyyy-MM-dd").alias("generated_on"),
        text_month(F.min(month)).alias("period_start"),
        text_month(F.max(month)).alias("period_end"),
        F.array_join(F.transform(months, text_month), ", ").alias("partial"),
        F.sum("orders_delivered").alias("delivered_orders"),
        F.sum("revenue_delivered").alias("revenue"),
        ratio(F.sum("revenue_delivered"), F.sum("orders_delivered")).alias("avg_order_value"),
    )
    none = F.coalesce(F.nullif(F.col("partial"), F.lit("")), F.lit("none"))
    return _lines(
        frame,
        [
            *[_label(n) for n in ("data_label", "generated_on", "period_start", "period_end")],
            ("partial_months", None, none),
            _number("delivered_orders", text_int),
            _number("revenue", text_int),
            _number("avg_order_value", text_int),
        ],
    )


#: The checks that facts quote.
QUOTED_CHECKS = (
    "orders_delivered_but_no_delivery_date",
    "orders_delivered_before_purchase",
    "products_missing_category",
    "orders_on_time_by_date_but_late_by_timestamp",
)


def quality_facts(dq_log: DataFrame) -> DataFrame:
    def affected(check: str) -> Column:
        return text_int(F.max(F.when(F.col("check") == check, F.col("rows_affected"))))

    frame = dq_log.agg(
        F.concat(
            F.lit("Delivered without a delivery date: "),
            affected("orders_delivered_but_no_delivery_date"),
            F.lit("; delivered before purchase: "),
            affected("orders_delivered_before_purchase"),
            F.lit(" (neither is in the delay figures). Products without a category: "),
            affected("products_missing_category"),
            F.lit("."),
        ).alias("dq_summary")
    )
    return _lines(frame, [_label("dq_summary")])


def delivery_facts(answers: Answers, dq_log: DataFrame, params: Params) -> list[DataFrame]:
    zero = F.lit(0)
    sides = answers["review_late_vs_on_time"].agg(
        _pick("avg_review", "late").alias("avg_review_late"),
        _pick("avg_review", "on_time").alias("avg_review_on_time"),
        F.coalesce(_pick("low_review_pct", "late"), zero).alias("low_review_pct_late"),
        _pick("low_review_pct", "on_time").alias("low_review_pct_on_time"),
        F.coalesce(_pick("answered_before_delivery_pct", "late"), zero).alias(
            "late_answered_before_delivery_pct"
        ),
        F.coalesce(_pick("answered_after_delivery", "late"), zero).alias(
            "late_answered_after_delivery"
        ),
        _pick("avg_review_answered_after_delivery", "late").alias(
            "avg_review_late_answered_after_delivery"
        ),
    )
    bands = answers["review_by_delay_bucket"].withColumn("_place", F.col("delay_bucket_order"))
    band = F.concat(
        "delay_bucket",
        F.lit(" "),
        text_two(F.col("avg_review")),
        F.lit(" (n="),
        text_int(F.col("orders_with_review")),
        F.lit(")"),
    )
    after = "avg_review_late_answered_after_delivery"
    return [
        _lines(
            late_rate_by_timestamp(answers, dq_log),
            [
                _number("late_rate_pct", text_pct),
                _number("late_rate_pct_by_timestamp", text_pct),
            ],
        ),
        _lines(
            review_gap_ci(answers),
            [
                _number(n, text_two)
                for n in ("review_gap", "review_gap_ci_low", "review_gap_ci_high")
            ],
        ),
        _lines(
            sides,
            [
                _number("avg_review_late", text_two),
                _number("avg_review_on_time", text_two),
                _number("low_review_pct_late", text_pct),
                _number("low_review_pct_on_time", text_pct),
                _number("late_answered_before_delivery_pct", text_pct),
                _number("late_answered_after_delivery", text_int),
                (after, F.col(after), _or_na(text_two(F.col(after)))),
            ],
        ),
        _lines(
            bands.agg(_listed(band, "", "; ").alias("review_by_delay_buckets")),
            [_label("review_by_delay_buckets")],
        ),
        _lines(worst_states(answers), [_label("worst_states")]),
        _lines(
            worst_states_what_if(answers, params),
            [
                _label("worst_state_codes"),
                _number("what_if_state_count", text_int),
                _number("late_orders_avoided", text_int),
                _number("low_reviews_avoided", text_int),
            ],
        ),
    ]


def customer_facts(answers: Answers) -> list[DataFrame]:
    def days(name: str, column: str) -> Line:
        return name, F.col(column), _or_na(text_int(F.col(column)))

    by_order_id = "repeat_rate_pct_if_counted_by_customer_id"
    return [
        _lines(
            answers["repeat_customer_rate"],
            [
                _number("customers", text_int),
                _number("repeat_customers", text_int),
                _number("repeat_rate_pct", text_pct),
                _number("repeat_rate_by_customer_id", text_pct, by_order_id),
                days("median_days_to_second_order", "median_days_first_to_second_order"),
                _number("repeat_same_day_only", text_int, "repeat_customers_same_day_only"),
                _number("repeat_rate_later_day_pct", text_pct, "repeat_rate_pct_later_day"),
                days("median_days_to_later_order", "median_days_to_later_day_order"),
            ],
        ),
        _lines(
            month1_retention(answers),
            [_number("month1_retention_pct", text_pct), _number("month1_cohorts", text_int)],
        ),
        _lines(
            repeat_uplift(answers),
            [
                _number("repeat_same_day_only_pct", text_pct),
                _number("extra_repeat_customers_per_point", text_int),
                _number("revenue_per_repeat_point", text_int),
            ],
        ),
    ]


def category_facts(answers: Answers) -> list[DataFrame]:
    overall = answers["freight_share"].filter(F.col("category") == ALL_CATEGORIES)
    return [
        _lines(
            top3_share(answers),
            [_label("top3_categories"), _number("top3_revenue_share_pct", text_pct)],
        ),
        _lines(overall, [_number("freight_share_pct", text_pct)]),
        _lines(
            freight_what_if(answers),
            [
                _label("high_freight_categories"),
                _label("high_freight_category_names"),
                _number("freight_reduction", text_int),
            ],
        ),
    ]


def memo_facts(
    answers: Answers,
    dq_log: DataFrame,
    params: Params,
    label: str,
    made_on: datetime.date | None = None,
) -> DataFrame:
    """All 46 facts as (fact, value, text)."""
    made = F.current_date() if made_on is None else F.lit(made_on)
    parts = [
        overview_facts(answers, label, made),
        quality_facts(dq_log),
        *delivery_facts(answers, dq_log, params),
        *customer_facts(answers),
        *category_facts(answers),
    ]
    return reduce(DataFrame.unionByName, parts)
