"""The batch run: check the files, load, clean, model, answer, export, reconcile, state the facts."""

from __future__ import annotations

import datetime
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from marketspark.operators.clean import BRAZIL, Box
from marketspark.operators.reconcile import reconcile
from marketspark.params import Params
from marketspark.plans.questions import QUESTIONS
from marketspark.plans.warehouse import Warehouse
from marketspark.sources.contract import FREE_TEXT, require_contract
from marketspark.sources.raw import load_summary, read_all
from marketspark.sources.sinks import export_model, export_results, write_files
from marketspark.sources.store import new_folder

QUESTION_TEXTS = {q.answer.__name__: q.text for q in QUESTIONS}
ANSWER_FILES = {q.answer.__name__: q.name for q in QUESTIONS}


@dataclass(frozen=True)
class PipelineResult:
    tables: Warehouse
    exported: dict[str, DataFrame]
    load_summary: DataFrame
    dq_log: DataFrame
    index: DataFrame
    reconciliation: DataFrame
    facts: DataFrame

    def mismatches(self) -> list[str]:
        """One line for each total that differs; the table has one row for each pair of totals."""
        rows = self.reconciliation.filter("not matches").collect()
        return [
            f"{r['metric']}: {r['sql_value']} ({r['sql_source']}) and {r['export_value']} ({r['export_source']})"
            for r in rows
        ]

    def findings(self) -> int:
        """Number of quality checks that found something."""
        return self.dq_log.filter("rows_affected > 0").count()

    def all_match(self) -> bool:
        return self.reconciliation.filter("not matches").isEmpty()


def run_pipeline(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    params: Params = Params(),
    label: str = "",
    made_on: datetime.date | None = None,
    box: Box = BRAZIL,
    states: DataFrame | None = None,
    fmt: str = "csv",
    free_text: Collection[str] = FREE_TEXT,
) -> PipelineResult:
    """Run every step under `out_dir`; raises SchemaContractError before anything is loaded.

    `free_text` names the tables whose fields may hold line breaks; the files of all others are split.
    """
    files = require_contract(spark, raw_dir)
    raw = read_all(spark, files, free_text)
    tables = Warehouse(
        spark,
        raw,
        params,
        states,
        box,
        folder=new_folder(spark, "lake"),
        store_raw=True,
        label=label,
        made_on=made_on,
    )
    summary = write_files(load_summary(tables.raw(), tables.rows_written()).coalesce(1), f"{out_dir}/load_summary")
    dq_log = write_files(tables["dq_log"].coalesce(1), f"{out_dir}/dq_log")
    answers = tables.answers()
    index = export_results(answers, QUESTION_TEXTS, ANSWER_FILES, f"{out_dir}/results", fmt)
    exported = export_model(tables.model(), answers, f"{out_dir}/export", fmt, stored=True)
    checked = write_files(reconcile(answers, exported).coalesce(1), f"{out_dir}/reconciliation")
    facts = tables["memo_facts"]
    facts.coalesce(1).write.mode("overwrite").json(f"{out_dir}/facts")
    written = spark.read.schema(facts.schema).json(f"{out_dir}/facts")
    return PipelineResult(tables, exported, summary, dq_log, index, checked, written)
