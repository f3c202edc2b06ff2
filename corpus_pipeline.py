"""A corpus pipeline of the text operators: each stage works on all rows that its predecessor kept.

The stages drop texts of low quality, near copies and leaked benchmark texts, blank secrets out, and
pack what is left. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketspark.llm import copies, decontaminate, packing, quality, secrets
from marketspark.llm.common import read, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that their labelled neighbours vote for."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: texts that the fingerprint operator links, and texts with a
    similarity of 0.8 or more of their five-word shingles, directly or through others."""
    return copies.drop_copies(docs, prints=True)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage."""
    return decontaminate.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with marks in place of secrets; n_chars follows the text."""
    return secrets.redact(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a text: its bin and the place in it."""
    return packing.pack_texts(docs)


#: (name, function of (spark, docs, sf_dir)).
STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmarks),
    ("secrets", no_secrets),
    ("packing", packed),
]
#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
