"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import (
    alignment,
    decontaminate,
    divergence,
    licences,
    oracles,
    packing,
    quality,
    rules,
    secrets,
    shards,
    simhash,
    tokens,
    toxicity,
    warc,
)
from marketspark.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op5_quality_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    offsets = F.transform("spans", lambda s: F.concat_ws(":", s["start_at"], s["end_at"]))
    return found.withColumn("spans", F.array_join(offsets, ","))


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(secrets.find_secrets(read(spark, sf_dir, "documents")))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_rules(read(spark, sf_dir, "documents"))
    return found.drop("char_distance", "word_distance")


ORACLES["op6_quality_rules"] = oracles.quality_rules_sql()


@query("op2_training_order")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_order(read(spark, sf_dir, "documents"))


@query("op4_licences")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.find_licences(read(spark, sf_dir, "documents"), licences.known_licences(spark))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(read(spark, sf_dir, "documents"))


@query("op13_warc")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


ORACLES["op13_warc"] = oracles.warc_sql()


@query("op12_source_divergence")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = oracles.divergence_sql()


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))
