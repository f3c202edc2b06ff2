from __future__ import annotations

import datetime

from marketspark.operators import model
from marketspark.sources import store
from tests.conftest import keyed, rows


def test_one_row_per_order_and_no_fan_out(run):
    orders = keyed(rows(run.tables["fact_orders"]), "order_id")
    assert len(orders) == 12
    o1, o4 = orders["o1"], orders["o4"]
    assert (o1["items_count"], o1["sellers_count"], float(o1["item_revenue"])) == (2, 2, 150)
    assert float(o1["payment_value"]) == 165 and o1["main_payment_type"] == "credit_card"
    assert (o4["items_count"], o4["distinct_products"]) == (3, 1)
    assert o4["main_payment_type"] == "credit_card"  # equal values: the earlier line
    assert (orders["o9"]["items_count"], float(orders["o9"]["item_revenue"])) == (0, 0)
    assert orders["o10"]["customer_unique_id"] is None


def test_three_valued_flags_and_bands(run):
    orders = keyed(rows(run.tables["fact_orders"]), "order_id")
    late = {o: orders[o]["is_late"] for o in ("o2", "o3", "o5", "o6", "o8")}
    assert late == {"o2": 0, "o3": 1, "o5": None, "o6": None, "o8": None}
    assert [orders[o]["delay_bucket_order"] for o in ("o1", "o3", "o4", "o7", "o5")] == [
        1, 2, 4, 5, None,
    ]
    assert orders["o7"]["delay_bucket"] == "15+ days late"
    early = [orders[o]["review_answered_before_delivery"] for o in ("o1", "o3", "o5")]
    assert early == [0, 1, None]


def test_item_and_payment_grain(run):
    items = rows(run.tables["fact_order_items"])
    assert len(items) == 14 and "o77" not in {i["order_id"] for i in items}
    assert {i["category"] for i in items if i["order_id"] == "o11"} == {"beauty"}
    assert {i["review_score"] for i in items if i["order_id"] == "o4"} == {1}
    payments = rows(run.tables["fact_payments"])
    assert len(payments) == 12
    assert {p["customer_state"] for p in payments if p["order_id"] == "o10"} == {None}


def test_people(run):
    people = keyed(rows(run.tables["dim_customer"]), "customer_unique_id")
    assert set(people) == {"ann", "bob", "cat", "dan", "eve", "fay", "gil"}
    eve = people["eve"]
    assert eve["customer_state"] == "PE"  # where the first order went
    assert (eve["orders_placed"], eve["delivered_orders"], eve["is_repeat_customer"]) == (3, 2, 1)
    assert eve["cohort_month"] == datetime.date(2020, 3, 1)
    assert people["fay"]["cohort_month"] is None and people["fay"]["is_repeat_customer"] == 0


def test_first_place_on_the_same_day_is_the_smaller_order(spark):
    schema = (
        "order_id string, customer_unique_id string, customer_state string, customer_city string,"
        " purchase_date date, is_delivered int"
    )
    day = datetime.date(2020, 1, 1)
    orders = spark.createDataFrame(
        [("b", "x", "SP", "s", day, 1), ("a", "x", "RJ", "r", day, 1), ("0", "x", "MG", "m", None, 1)],
        schema,
    )
    (row,) = rows(model.dim_customer(orders))
    assert (row["customer_state"], row["customer_city"]) == ("RJ", "r")


def test_dimensions(run):
    states = keyed(rows(run.tables["dim_state"]), "state_code")
    assert len(states) == 27
    assert states["RS"]["map_location"] == "Rio Grande do Sul, Brazil"
    assert states["RS"]["latitude"] == -30 and states["AC"]["latitude"] is None
    days = rows(run.tables["dim_date"])
    assert len(days) == 366 and len({d["date"] for d in days}) == 366
    first = min(days, key=lambda d: d["date"])
    assert (first["weekday_number"], first["weekday_name"]) == (3, "Wed")
    assert (first["month_name"], first["year_month"], first["quarter"]) == ("Jan", "2020-01", 1)
    assert len(rows(run.tables["dim_seller"])) == 2 and len(rows(run.tables["dim_product"])) == 5


def test_main_payment_type_is_hashed_not_sorted(spark):
    lines = [
        ("a", 1, "x", "5.00"), ("a", 2, "b", "5.00"), ("a", 1, "a", "5.00"), ("a", 0, "z", "4.99"),
        ("b", None, "z", "-3.10"), ("b", 5, "y", "-3.10"),
        ("c", 1, None, "9.99"), ("c", 2, "q", None),
        ("d", -4, "k", "0.00"), ("d", -4, "j", "0.00"), ("d", 3, "i", "-0.01"),
        ("e", 1, "m", "9999999999.99"), ("e", 2, "l", "-9999999999.99"),
    ]
    df = spark.createDataFrame(lines, "order_id string, payment_sequential int, payment_type string, value string")
    best = model.payments_per_order(df.selectExpr("*", "cast(value AS decimal(12,2)) AS payment_value"))
    got = {r["order_id"]: (str(r["payment_value"]), r["main_payment_type"]) for r in best.collect()}
    assert got == {
        "a": ("19.99", "a"), "b": ("-6.20", "y"), "c": ("9.99", None), "d": ("-0.01", "j"), "e": ("0.00", "m"),
    }
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()


def test_orders_and_reviews_meet_without_a_shuffle(spark, run):
    """They lie in buckets by order; what is shuffled by order is folded lines, to the same buckets."""
    names = ("clean_orders", "clean_customers", "clean_order_items", "clean_payments", "clean_reviews")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        plan = model.fact_orders(*run.tables.together(*names))._jdf.queryExecution().executedPlan()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = str(plan.toString()).splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
    assert len(scans) == 2 and all("SelectedBucketsCount" in lines[i] for i in scans)
    for i in scans:  # the nodes above a scan, up to the join: fewer bars and colons stand before them
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-*()0123456789"))
        above = []
        for line in reversed(lines[:i]):
            own = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if own < depth:
                depth = own
                above.append(line)
                if "Join" in line:
                    break
        assert "Join" in above[-1] and not any("Exchange" in line for line in above)


def test_buckets_are_dropped_with_the_run(spark):
    lake = store.Lake(spark, {"clean_orders": lambda t: spark.range(9).selectExpr("cast(id AS string) AS order_id")}, buckets=3)
    assert lake["clean_orders"].count() == 9
    (table,) = lake._tables
    assert spark.catalog.tableExists(table) and lake.drop() and not spark.catalog.tableExists(table)
    plain = store.Lake(spark, {"clean_orders": lambda t: spark.range(9).selectExpr("cast(id AS string) AS order_id")}, buckets=0)
    assert plain["clean_orders"].count() == 9 and plain._tables == [] and plain.drop()


def test_counts_are_taken_while_tables_are_written(spark, run):
    """The numbers of the summary and of plain checks equal those of scans, and no scan of the tables is in the plans."""
    from marketspark.operators import quality
    from marketspark.sources import raw

    tables = run.tables
    assert set(tables.rows_written()) == set(tables.raw_names)
    known, scanned = raw.load_summary(tables.raw(), tables.rows_written()), raw.load_summary(tables.raw())
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, scanned.collect()))
    assert "FileScan" not in known._jdf.queryExecution().executedPlan().toString()
    names = ["products_missing_category", "products_category_without_english_name", "payments_type_not_defined", "payments_zero_value"]
    names += ["customers_zip_prefix_lost_leading_zero", "sellers_zip_prefix_lost_leading_zero"]
    log = quality.quality_log(tables, names)
    assert "FileScan" not in log._jdf.queryExecution().executedPlan().toString()
    plain = quality.quality_log({n: tables[n] for n in ("clean_products", "clean_payments", "raw_customers", "raw_sellers")}, names)
    assert sorted(map(tuple, log.collect())) == sorted(map(tuple, plain.collect()))
    assert any(r["rows_affected"] for r in log.collect())
