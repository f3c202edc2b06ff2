"""Raw-shaped marketplace tables derived from TPC-H-like star tables.

Every column is text, as it would arrive from a CSV export. Key arithmetic plants the defects that
cleaning must survive: copies, unreadable stamps, lost zeros, blank categories, orphans, odd
numbers. Each rule uses integer or decimal arithmetic only, so any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.params import Params

#: Cut-offs with groups on both sides at scale factor 0.01.
PARAMS = Params(
    min_category_orders=550,
    min_state_orders=170,
    min_route_orders=20,
    min_seller_orders=147,
    min_cohort_size=45,
    worst_states_for_what_if=5,
)


def _e(sql: str) -> Column:
    return F.expr(sql)


def _copies(condition: str) -> Column:
    return _e(f"explode(if({condition}, array(1, 2), array(1)))").alias("copy")


def _stamp(sql: str) -> str:
    return f"date_format({sql}, 'yyyy-MM-dd HH:mm:ss')"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        "o_orderstatus",
        _e("cast(o_orderdate as timestamp_ntz)").alias("d"),
        _e("cast(pmod(o_orderkey * 7 + floor(o_totalprice), 45) as int) - 2").alias("days"),
        _e("7 + 7 * cast(substr(o_orderpriority, 1, 1) as int)").alias("promise"),
        _copies("o_orderkey % 83 = 0"),
    )
    bought = "d + make_dt_interval(copy - 1, cast(k % 24 as int), cast(k % 60 as int))"
    arrived = "d + make_dt_interval(days, cast(k % 20 as int), 30)"
    return base.select(
        _e("cast(k as string)").alias("order_id"),
        _e("if(k % 307 = 0, null, concat('c', k))").alias("customer_id"),
        _e(
            """case when k % 211 = 0 then null
                    when o_orderstatus = 'F' then if(k % 5 = 0, ' DELIVERED', 'delivered')
                    when o_orderstatus = 'P' then if(k % 2 = 0, 'canceled', 'unavailable ')
                    else 'shipped' end"""
        ).alias("order_status"),
        _e(
            f"""case when k % 97 = 0 then 'not a date'
                     when k % 101 = 0 then date_format(d, 'yyyy')
                     when k % 89 = 0 then date_format({bought}, 'yyyy/MM/dd HH:mm:ss')
                     else {_stamp(bought)} end"""
        ).alias("order_purchase_timestamp"),
        _e(f"if(k % 9 = 0, '', {_stamp(bought + ' + interval 1 hour')})").alias(
            "order_approved_at"
        ),
        _e(f"if(k % 11 = 0, null, {_stamp(bought + ' + interval 1 day')})").alias(
            "order_delivered_carrier_date"
        ),
        _e(
            f"""case when k % 67 = 0 then null
                     when o_orderstatus = 'F' or k % 7 = 0 then {_stamp(arrived)} end"""
        ).alias("order_delivered_customer_date"),
        _e(f"if(k % 173 = 0, '', {_stamp('d + make_dt_interval(promise)')})").alias(
            "order_estimated_delivery_date"
        ),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order's customer_id; a third of the orders belong to one-time buyers."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    return (
        orders.filter("o_orderkey % 71 <> 0")
        .join(customer, _e("o_custkey = c_custkey"))
        .join(nation, _e("c_nationkey = n_nationkey"))
        .select(F.col("o_orderkey").alias("k"), "o_custkey", "c_nationkey", "n_name",
                _copies("o_orderkey % 131 = 0"))
        .select(
            _e("concat('c', k)").alias("customer_id"),
            _e(
                """case when copy = 2 then concat('z', k)
                        when k % 3 = 0 then concat('p', k)
                        when k % 3 = 1 then concat('u', o_custkey)
                        else concat('h', cast(floor(k / 12) as bigint)) end"""
            ).alias("customer_unique_id"),
            _e(
                """if(k % 61 = 0, cast(k * 37 % 10000 as string),
                      lpad(cast(k * 37 % 100000 as string), 5, '0'))"""
            ).alias("customer_zip_code_prefix"),
            _e("concat(' City ', c_nationkey % 7)").alias("customer_city"),
            _e("if(k % 3 = 0, lower(n_name), concat(n_name, ' '))").alias("customer_state"),
        )
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("line"),
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        _e("cast(l_extendedprice as decimal(12,2))").alias("price"),
        _e("cast(l_tax as decimal(4,2))").alias("tax"),
        _copies("l_orderkey % 127 = 0"),
    )
    return base.select(
        _e("if(k % 113 = 0, concat('missing-', k), cast(k as string))").alias("order_id"),
        _e("if(line = 7 and k % 19 = 0, '7.0', cast(line as string))").alias("order_item_id"),
        _e("if(k % 109 = 0, null, concat('p', l_partkey))").alias("product_id"),
        _e("concat('s', l_suppkey)").alias("seller_id"),
        _e("date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')").alias("shipping_limit_date"),
        _e(
            """case when k % 103 = 0 and line = 1 then 'n/a'
                    when k % 107 = 0 and line = 2 then '0'
                    else cast(price as string) end"""
        ).alias("price"),
        _e("cast(cast(price * tax as decimal(12,2)) as string)").alias("freight_value"),
    )


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        _e("cast(l_orderkey as string)").alias("order_id"),
        _e("cast(l_linenumber as string)").alias("payment_sequential"),
        _e(
            """case when l_orderkey % 137 = 0 then 'not_defined'
                    when l_returnflag = 'A' then 'credit_card'
                    when l_returnflag = 'N' then ' Boleto'
                    else 'voucher' end"""
        ).alias("payment_type"),
        _e("cast(cast(floor(l_quantity) as bigint) as string)").alias("payment_installments"),
        _e(
            """case when l_orderkey % 137 = 0 then '0.00'
                    when l_orderkey % 10 = 0 then '50.00'
                    else cast(cast(l_extendedprice as decimal(12,2)) as string) end"""
        ).alias("payment_value"),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviews for every third order; stamps follow the event number."""
    base = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("e"),
        "event_type",
        "props",
        "value",
        _e(
            "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(event_id * 7919 % 2404 as int))"
        ).alias("made"),
    )
    return base.select(
        _e("concat('r', if(e % 50 = 49, e - 1, e))").alias("review_id"),
        _e("cast(cast(floor(e / 2) as bigint) * 3 as string)").alias("order_id"),
        _e(
            """case when e % 211 = 0 then 'five'
                    when e % 223 = 0 then '4.0'
                    else cast(1 + cast(floor(value) as bigint) % 6 as string) end"""
        ).alias("review_score"),
        F.col("event_type").alias("review_comment_title"),
        _e("concat('said:', char(10), props)").alias("review_comment_message"),
        _e(_stamp("made")).alias("review_creation_date"),
        _e(
            f"""if(e % 41 = 0, null,
                {_stamp("made + make_dt_interval(cast(e % 30 as int), cast(e % 24 as int))")})"""
        ).alias("review_answer_timestamp"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"),
        "p_name",
        "p_size",
        _e("lower(replace(p_brand, '#', '_'))").alias("brand"),
        _e("cast(p_retailprice as decimal(12,2))").alias("weight"),
        _copies("p_partkey % 149 = 0"),
    )
    return base.select(
        _e("concat('p', k)").alias("product_id"),
        _e("case when k % 53 = 0 then ' ' when copy = 2 then 'zzz' else brand end").alias(
            "product_category_name"
        ),
        _e("cast(length(p_name) as string)").alias("product_name_length"),
        _e("if(k % 47 = 0, '1e2', cast(p_size * 10 as string))").alias(
            "product_description_length"
        ),
        _e("if(k % 43 = 0, '2.7', cast(p_size as string))").alias("product_photos_qty"),
        _e("if(k % 59 = 0, 'heavy', cast(weight as string))").alias("product_weight_g"),
        _e("cast(p_size as string)").alias("product_length_cm"),
        _e("cast(p_size + 1 as string)").alias("product_height_cm"),
        _e("if(k % 37 = 0, '', cast(p_size + 2 as string))").alias("product_width_cm"),
    )


def raw_category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand but two has a name; one keeps its own, one has two."""
    brands = read_table(spark, sf_dir, "part").select(
        _e("lower(replace(p_brand, '#', '_'))").alias("brand")
    ).distinct().filter("brand not in ('brand_5', 'brand_12')")
    return brands.select(
        "brand",
        _e(
            """explode(case when brand = 'brand_3' then array('brand_3')
                            when brand = 'brand_7' then array('seventh', 'line seven')
                            else array(replace(brand, 'brand_', 'line ')) end)"""
        ).alias("product_category_name_english"),
    ).select(F.col("brand").alias("product_category_name"), "product_category_name_english")


def raw_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    return (
        read_table(spark, sf_dir, "supplier")
        .join(nation, _e("s_nationkey = n_nationkey"))
        .select(
            _e("concat('s', s_suppkey)").alias("seller_id"),
            _e(
                """if(s_suppkey % 13 = 0, cast(s_suppkey * 41 % 10000 as string),
                      lpad(cast(s_suppkey * 41 % 100000 as string), 5, '0'))"""
            ).alias("seller_zip_code_prefix"),
            _e("concat('Town ', s_nationkey % 5, ' ')").alias("seller_city"),
            _e("if(s_suppkey % 2 = 0, lower(n_name), n_name)").alias("seller_state"),
        )
    )


def raw_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer balances read as coordinates: some fall outside the box, some are copies."""
    nation = read_table(spark, sf_dir, "nation")
    return (
        read_table(spark, sf_dir, "customer")
        .join(nation, _e("c_nationkey = n_nationkey"))
        .select(
            F.col("c_custkey").alias("k"),
            "c_nationkey",
            "n_name",
            _e("cast(c_acctbal as decimal(12,2))").alias("b"),
            _copies("c_custkey % 157 = 0"),
        )
        .select(
            _e("lpad(cast(k * 17 % 100000 as string), 5, '0')").alias(
                "geolocation_zip_code_prefix"
            ),
            _e("if(k % 151 = 0, 'x', cast(b * 0.005 - 30.0 as string))").alias("geolocation_lat"),
            _e("cast(b * -0.004 - 38.0 as string)").alias("geolocation_lng"),
            _e("concat('City ', c_nationkey % 7)").alias("geolocation_city"),
            _e("if(k % 2 = 0, lower(n_name), n_name)").alias("geolocation_state"),
        )
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state list for dim_state: nations with their region."""
    region = read_table(spark, sf_dir, "region")
    return (
        read_table(spark, sf_dir, "nation")
        .join(region, _e("n_regionkey = r_regionkey"))
        .select(
            _e("upper(n_name)").alias("state_code"),
            _e("concat('State ', n_nationkey)").alias("state_name"),
            _e("r_name").alias("region"),
        )
    )


RAW = {
    "customers": raw_customers,
    "geolocation": raw_geolocation,
    "order_items": raw_order_items,
    "payments": raw_payments,
    "reviews": raw_reviews,
    "orders": raw_orders,
    "products": raw_products,
    "sellers": raw_sellers,
    "category_translation": raw_category_translation,
}


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: build(spark, sf_dir) for name, build in RAW.items()}
