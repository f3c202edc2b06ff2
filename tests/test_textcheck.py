from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketspark.operators import textcheck
from tests.conftest import keyed, rows

FACTS = [("late", "25.0%"), ("revenue", "1,970"), ("stars", "1.50"), ("big", "13,221,498")]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(FACTS, "fact string, text string")


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_numbers_are_found_without_separators(spark):
    docs = docs_of(spark, "BRL 1,970 and 25.0% in 2017, or 3,", "none", None)
    found = [(r["pos"], r["number"]) for r in rows(textcheck.extract_numbers(docs))]
    assert sorted(found) == [(0, "1970"), (1, "25.0"), (2, "2017"), (3, "3")]


def test_spellings(spark):
    wanted = {
        "4.50": {"4.5", "4", "4.50"},
        "1234567": {"1234567", "1234567.0", "1234567.00"},
        "0.125": {"0.125", "0", "0.1", "0.12"},
        "0.1250001": {"0.1250001", "0", "0.1", "0.13"},
        "0.125000000001": {"0.125000000001", "0", "0.1", "0.13"},
        "1234567.891": {"1234567.891", "1234568", "1234567.9", "1234567.89"},
        "0000000000000042": {"42", "42.0", "42.00"},
        "000.0": {"0", "0.0", "0.00"},
        "12345678901234567890": {"12345678901234567890", "12345678901234567890.0", "12345678901234567890.00"},
        "9" * 40 + ".50": {"9" * 40 + ".5"},
    }
    df = spark.createDataFrame([(n,) for n in wanted], "n string")
    made = {n: set(v) for n, v in df.select("n", textcheck.variants(F.col("n"))).collect()}
    assert made == wanted


def test_verdicts(spark, facts):
    docs = docs_of(
        spark,
        "Revenue was 1970; 25% were late, 1.5 stars, 3 findings.",
        "25.0% were late; this would add 12% and 12%, or 99.",
        "no numbers",
        "13,221,512 is close to the revenue",  # equal to the fact in six digits only
        None,
        "000000000000001970 and 0013,221,498",
    )
    found = keyed(rows(textcheck.number_check(docs, facts)), "doc_id")
    assert [found[i]["passed"] for i in range(4)] == [True, False, True, False]
    assert (found[1]["numbers_in_text"], found[1]["unsupported_numbers"]) == (4, "12 12 99")
    assert found[3]["unsupported_numbers"] == "13221512"
    assert (found[0]["numbers_in_text"], found[2]["numbers_in_text"]) == (4, 0)
    assert (found[4]["numbers_in_text"], found[4]["passed"]) == (0, True)
    assert found[5]["passed"]


def test_repeated_and_missing_keys_stay_rows_of_their_own(spark, facts):
    docs = spark.createDataFrame(
        [(1, "5000"), (1, "77"), (None, "5001"), (None, "25%"), (2, "")], "doc_id bigint, text string"
    )
    found = sorted((str(r["doc_id"]), r["unsupported_numbers"], r["passed"]) for r in rows(textcheck.number_check(docs, facts)))
    assert found == [
        ("1", "5000", False),
        ("1", "77", False),
        ("2", "", True),
        ("None", "", True),
        ("None", "5001", False),
    ]
    assert len(rows(textcheck.unsupported_numbers(docs, facts))) == 3


def test_small_numbers_need_no_facts(spark):
    none = spark.createDataFrame([], "fact string, text string")
    assert {r["variant"] for r in rows(textcheck.allowed_numbers(none))} == {str(n) for n in range(11)}
    found = rows(textcheck.number_check(docs_of(spark, "10 of 11"), none))
    assert [(f["numbers_in_text"], f["unsupported_numbers"]) for f in found] == [(2, "11")]


def test_many_facts_make_no_other_plan(spark):
    many = spark.range(5000).selectExpr("cast(id AS string) AS fact", "cast(id * 7 AS string) AS text")
    found = keyed(rows(textcheck.number_check(docs_of(spark, "34993", "34994 and 14"), many)), "doc_id")
    assert found[0]["passed"] and found[1]["unsupported_numbers"] == "34994"


def test_one_number_in_most_texts(spark, facts):
    docs = docs_of(spark, *["in 2017 and 1970"] * 300, *["2018"] * 5)
    bad = rows(textcheck.unsupported_numbers(docs, facts))
    assert len(bad) == 305 and {b["number"] for b in bad} == {"2017", "2018"}


def test_pipeline_facts_back_their_own_texts(run):
    docs = run.facts.select(F.xxhash64("fact").alias("doc_id"), "text")
    assert rows(textcheck.number_check(docs, run.facts).filter("not passed")) == []
