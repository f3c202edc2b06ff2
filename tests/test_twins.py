"""Every registered query against its DuckDB twin on the smallest tables, and the shape of its plan."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from check import differences, open_tables
from marketspark.plans import catalog, warehouse
from oracle import ORACLES

SF_DIR = "/root/testdata/sf0.001"
QUERIES, TWINS = catalog.QUERIES, dict(ORACLES)  # without the text operators, which have own tests

# No row may leave the JVM, and no join may pair all rows with all rows.
FORBIDDEN = ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


#: Stored tables whose size follows the calendar, the regions or the categories, not the input.
SMALL = [*warehouse.ANSWERS, *warehouse.REPORTS, "clean_state_centroids", "dim_state", "dim_date", "dim_product"]


def executed(spark) -> dict[int, str]:
    """Execution -> the plan that ran in the end, the jobs that write stored tables among them."""
    found, runs = {}, spark._jsparkSession.sharedState().statusStore().executionsList().iterator()
    while runs.hasNext():
        run = runs.next()
        found[run.executionId()] = run.physicalPlanDescription() or ""
    return found


@pytest.fixture(scope="module", autouse=True)
def earlier(spark):
    """Executions of other tests."""
    return set(executed(spark))


def below_single_partitions(plan: str) -> list[tuple[str, list[str]]]:
    """(names, scanned folders) of the nodes under each exchange to one task, down to the next exchange."""
    tree, _, details = plan.partition("\n\n")
    about = dict(re.findall(r"\n\((\d+)\) ([^\n]*(?:\n[^\n(][^\n]*)*)", f"\n{details}"))
    nodes = [
        (match.start(1), match[1].strip(), match[2])
        for line in tree.split("== Initial Plan ==")[0].splitlines()
        if (match := re.search(r"([A-Z]\w*[^()]*?)\s*(?:\[\w+ id : \d+\])?\s*\((\d+)\)", line))
    ]
    found = []
    for i, (depth, name, number) in enumerate(nodes):
        if name.startswith("Exchange") and "Arguments: SinglePartition" in about.get(number, ""):
            names, scans, cut = [], [], None
            for under, other, of in nodes[i + 1 :]:
                if under <= depth:
                    break
                if cut is not None and under > cut:
                    continue
                cut = under if "Exchange" in other else None
                names.append(other)
                if other.startswith("Scan"):
                    scans += re.findall(r"Location: \S+ \[([^\]]*)\]", about.get(of, ""))
            found.append((" ".join(names), scans))
    return found


@pytest.fixture(scope="module")
def db():
    return open_tables(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert [r["delay_bucket_order"] for r in entry.entry(spark).collect()] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("name", QUERIES)
def test_twin(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    # Whatever meets in one task has been aggregated, or cut to its first rows, before.
    for below in re.findall(r"Exchange SinglePartition.*\n(.*)\n", plan):
        assert re.search(r"Aggregate|Project|Window|Filter|TakeOrdered", below), below
        assert "FileScan" not in below
    assert differences(df, df.collect(), db.execute(TWINS[name])) == []


def test_executed_plans(spark, earlier):
    """All plans that ran for this module, with the jobs that write stored tables."""
    plans = {k: plan for k, plan in executed(spark).items() if k not in earlier}
    assert len(plans) > 200 and any("InsertIntoHadoopFsRelationCommand" in p for p in plans.values())
    for plan in plans.values():
        assert not [word for word in FORBIDDEN if word in plan]
        for names, scans in below_single_partitions(plan):
            folded = re.search("Aggregate|Window|Limit|TakeOrdered", names)
            small = all(any(f"/{name}" in folder for name in SMALL) for folder in scans)
            assert folded or small, (names, scans)
