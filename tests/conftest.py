from __future__ import annotations

import csv
import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketspark.params import SMALL_DATA
from marketspark.plans.pipeline import run_pipeline
from marketspark.session import local_session
from tests import fixture


@pytest.fixture(scope="session")
def spark():
    return local_session()


def write_files(folder: Path, tables: dict) -> Path:
    """The fixture as CSV files of the contract."""
    folder.mkdir(parents=True, exist_ok=True)
    for name, (file, header, rows) in tables.items():
        bom = "﻿" if name == "category_translation" else ""
        with open(folder / file, "w", newline="", encoding="utf-8") as out:
            out.write(bom)
            writer = csv.writer(out)
            writer.writerow(header)
            writer.writerows(rows)
    return folder


@pytest.fixture(scope="session")
def run(spark, tmp_path_factory):
    """The whole pipeline, once, on the hand-made files."""
    base = tmp_path_factory.mktemp("run")
    raw = write_files(base / "raw", fixture.tables())
    return run_pipeline(
        spark,
        str(raw),
        str(base / "out"),
        SMALL_DATA,
        "hand-made",
        datetime.date(2020, 6, 1),
    )


@pytest.fixture(scope="session")
def answers(run):
    """Question name -> list of row dicts, in answer order."""
    return {name: rows(df) for name, df in run.tables.answers().items()}


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def keyed(items: list[dict], key: str) -> dict:
    return {item[key]: item for item in items}
