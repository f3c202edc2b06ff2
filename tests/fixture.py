"""A shop of twelve orders, made by hand: every row is there for one rule, and answers are on paper.

o1  two sellers, on time; its order row and one item row appear twice
o2  delivered in the evening of the promised day: on time by date, late by the clock
o3  two days late, paid less than goods and freight, review answered before the parcel came
o4  nine days late, three units of one product, two reviews, a tie between payment types;
    same person and same day as o3
o5  delivered without a delivery date        o6  delivered before it was bought
o7  nineteen days late, one unreadable price, score out of range
o8  shipped     o9  cancelled with a delivery date     o12 unavailable
o10 unreadable purchase stamp, unknown customer
o11 the same person as o7, one order line with two products
"""

from __future__ import annotations


def tables() -> dict:
    return {
        "customers": (
            "shop_customers_dataset.csv",
            [
                "customer_id",
                "customer_unique_id",
                "customer_zip_code_prefix",
                "customer_city",
                "customer_state",
            ],
            [
                ["k1", "ann", "1234", " Porto Alegre ", "rs"],
                ["k2", "ann", "90001", "porto alegre", "RS "],
                ["k3", "bob", "20001", "Rio", "RJ"],
                ["k4", "bob", "20001", "rio", "rj"],
                ["k5", "cat", "30001", "bh", "MG"],
                ["k6", "dan", "40001", "salvador", "BA"],
                ["k7", "eve", "50001", "recife", "PE"],
                ["k8", "eve", "50001", "recife", "SP"],
                ["k9", "fay", "60001", "natal", "RN"],
                ["k11", "eve", "01001", "sao paulo", "SP"],
                ["k12", "gil", "70001", "goiania", "GO"],
                ["k12", "zed", "70001", "goiania", "GO"],
            ],
        ),
        "orders": (
            "shop_orders_dataset.csv",
            [
                "order_id",
                "customer_id",
                "order_status",
                "order_purchase_timestamp",
                "order_approved_at",
                "order_delivered_carrier_date",
                "order_delivered_customer_date",
                "order_estimated_delivery_date",
            ],
            [
                _order("o1", "k1", " Delivered", "2020-01-05 10:00:00", "2020-01-10 12:00:00", "2020-01-15"),
                _order("o1", "k1", " Delivered", "2020-01-05 10:00:00", "2020-01-10 12:00:00", "2020-01-15"),
                _order("o2", "k2", "delivered", "2020-02-04 09:00:00", "2020-02-12 18:00:00", "2020-02-12"),
                _order("o3", "k3", "delivered", "2020-01-20 08:00:00", "2020-01-29 08:00:00", "2020-01-27"),
                _order("o4", "k4", "delivered", "2020-01-20 21:00:00", "2020-02-08 10:00:00", "2020-01-30"),
                _order("o5", "k5", "delivered", "2020-02-10 10:00:00", "", "2020-02-20"),
                _order("o6", "k6", "delivered", "2020-03-03 12:00:00", "2020-03-01 10:00:00", "2020-03-20"),
                _order("o7", "k7", "delivered", "2020/03/15 10:00:00", "2020-04-20 10:00:00", "2020-04-01"),
                _order("o8", "k8", "shipped", "2020-04-02 10:00:00", "", "2020-04-20"),
                _order("o9", "k9", "canceled", "2020-04-03 10:00:00", "2020-04-09 10:00:00", "2020-04-20"),
                _order("o10", "k10", "delivered", "2020", "2020-04-10 10:00:00", "2020-04-20"),
                _order("o11", "k11", "delivered", "2020-04-05 10:00:00", "2020-04-12 10:00:00", "2020-04-20"),
                _order("o12", "k12", "unavailable", "2020-05-01 10:00:00", "", "2020-05-20"),
            ],
        ),
        "order_items": (
            "shop_order_items_dataset.csv",
            [
                "order_id",
                "order_item_id",
                "product_id",
                "seller_id",
                "shipping_limit_date",
                "price",
                "freight_value",
            ],
            [
                _item("o1", "1", "p1", "s1", "100.00", "10.00"),
                _item("o1", "1", "p1", "s1", "100.00", "10.00"),
                _item("o1", "2", "p2", "s2", "50.00", "5.00"),
                _item("o2", "1", "p1", "s1", "100.00", "10.00"),
                _item("o3", "1", "p3", "s2", "200.00", "30.00"),
                _item("o4", "1", "p4", "s1", "40.00", "8.00"),
                _item("o4", "2", "p4", "s1", "40.00", "8.00"),
                _item("o4", "3", "p4", "s1", "40.00", "8.00"),
                _item("o5", "1", "p2", "s2", "60.00", "6.00"),
                _item("o6", "1", "p5", "s1", "80.00", "4.00"),
                _item("o7", "1", "p1", "s2", "x", "2.00"),
                _item("o7", "2", "p3", "s1", "150.00", "15.00"),
                _item("o8", "1", "p1", "s1", "99.00", "9.00"),
                _item("o10", "1", "p1", "s1", "70.00", "7.00"),
                _item("o11", "1", "p3", "s1", "500.00", "50.00"),
                _item("o11", "1", "p2", "s2", "55.00", "5.00"),
                _item("o77", "1", "p1", "s1", "10.00", "1.00"),
            ],
        ),
        "payments": (
            "shop_order_payments_dataset.csv",
            [
                "order_id",
                "payment_sequential",
                "payment_type",
                "payment_installments",
                "payment_value",
            ],
            [
                ["o1", "1", "credit_card", "3", "100.00"],
                ["o1", "2", "voucher", "1", "65.00"],
                ["o2", "1", " Boleto ", "1", "110.00"],
                ["o3", "1", "credit_card", "2", "200.00"],
                ["o4", "2", "voucher", "1", "72.00"],
                ["o4", "1", "credit_card", "1", "72.00"],
                ["o5", "1", "boleto", "1", "66.00"],
                ["o6", "1", "boleto", "1", "84.00"],
                ["o7", "1", "credit_card", "4", "167.00"],
                ["o9", "1", "not_defined", "1", "0.00"],
                ["o10", "1", "boleto", "1", "77.00"],
                ["o11", "1", "boleto", "1", "60.00"],
                ["o11", "1", "BOLETO", "1", "60.00"],
            ],
        ),
        "reviews": (
            "shop_order_reviews_dataset.csv",
            [
                "review_id",
                "order_id",
                "review_score",
                "review_comment_title",
                "review_comment_message",
                "review_creation_date",
                "review_answer_timestamp",
            ],
            [
                _review("r1", "o1", "5", "2020-01-12 10:00:00"),
                _review("r2", "o2", "4", "2020-02-14 10:00:00", 'came in the\nevening, "fine"'),
                _review("r3", "o3", "2", "2020-01-28 10:00:00"),
                _review("r4", "o4", "1", "2020-02-09 10:00:00"),
                _review("r5", "o4", "3", "2020-02-01 10:00:00"),
                _review("r1", "o5", "4", "2020-02-20 10:00:00"),
                _review("r7", "o7", "9", "2020-04-25 10:00:00"),
                _review("r8", "o11", "3.0", "2020-04-13 10:00:00"),
                _review("r9", "o8", "5", "2020-04-30 10:00:00"),
            ],
        ),
        "products": (
            "shop_products_dataset.csv",
            [
                "product_id",
                "product_category_name",
                "product_name_lenght",
                "product_description_lenght",
                "product_photos_qty",
                "product_weight_g",
                "product_length_cm",
                "product_height_cm",
                "product_width_cm",
            ],
            [
                ["p1", "moveis", "10", "1e2", "2.7", "500", "10", "10", "10"],
                ["p2", "beleza", "10", "20", "1", "heavy", "10", "10", "10"],
                ["p3", " ", "10", "20", "1", "500", "10", "10", "10"],
                ["p4", "pet", "10", "20", "1", "500", "10", "10", "10"],
                ["p5", "raro", "10", "20", "1", "500", "10", "10", ""],
            ],
        ),
        "sellers": (
            "shop_sellers_dataset.csv",
            ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
            [["s1", "04000", "Sao Paulo", "sp"], ["s2", "4001", " rio ", "RJ"]],
        ),
        "geolocation": (
            "shop_geolocation_dataset.csv",
            [
                "geolocation_zip_code_prefix",
                "geolocation_lat",
                "geolocation_lng",
                "geolocation_city",
                "geolocation_state",
            ],
            [
                ["90001", "-30.0", "-51.0", "porto alegre", "RS"],
                ["90001", "-30.0", "-51.0", "porto alegre", "RS"],
                ["90002", "-29.0", "-50.0", "canoas", "rs"],
                ["90003", "-31.0", "-53.0", "bage", "RS"],
                ["01001", "-23.5", "-46.6", "sao paulo", "SP"],
                ["01002", "-23.4", "-46.8", "osasco", "SP"],
                ["99999", "38.7", "-9.1", "lisboa", "SP"],
            ],
        ),
        "category_translation": (
            "product_category_name_translation.csv",
            ["product_category_name", "product_category_name_english"],
            [
                ["moveis", "garden furniture"],
                ["moveis", "furniture"],
                ["beleza", "beauty"],
                ["pet", "pet"],
            ],
        ),
    }


def _order(order: str, customer: str, status: str, bought: str, arrived: str, promised: str) -> list:
    return [order, customer, status, bought, bought, "", arrived, f"{promised} 00:00:00"]


def _item(order: str, line: str, product: str, seller: str, price: str, freight: str) -> list:
    return [order, line, product, seller, "2020-01-31 00:00:00", price, freight]


def _review(review: str, order: str, score: str, answered: str, text: str = "") -> list:
    return [review, order, score, "", text, answered, answered]
