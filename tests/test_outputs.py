"""Facts, dashboard queries, exports, reconciliation and the exit rule."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketspark.__main__ import main
from marketspark.params import SMALL_DATA
from marketspark.plans import dashboard, facts
from marketspark.plans.pipeline import run_pipeline
from marketspark.sources.contract import SchemaContractError
from marketspark.sources.sinks import EXPORT_COLUMNS, export_table
from tests import fixture
from tests.conftest import keyed, rows, write_files


def test_undated_order_makes_two_totals_differ(run):
    """o10 has no month, so the monthly answer misses it: the check must say so."""
    lines = keyed(rows(run.reconciliation), "metric")
    assert len(lines) == 7
    assert {m for m, line in lines.items() if not line["matches"]} == {"delivered_orders", "revenue"}
    assert (float(lines["revenue"]["sql_value"]), float(lines["revenue"]["export_value"])) == (915, 985)
    assert float(lines["freight"]["expected_value"]) == 118
    assert not run.all_match()


def test_everything_matches_once_the_order_is_dated(spark, tmp_path):
    tables = fixture.tables()
    for row in tables["orders"][2]:
        if row[0] == "o10":
            row[3] = "2020-04-01 10:00:00"
    raw = write_files(tmp_path / "raw" / "inner", tables).parent  # one level below
    result = run_pipeline(spark, str(raw), str(tmp_path / "out"), SMALL_DATA, fmt="parquet")
    assert result.all_match()


def test_missing_files_stop_the_run(spark, tmp_path):
    tables = fixture.tables()
    del tables["orders"]
    raw = write_files(tmp_path / "raw", tables)
    with pytest.raises(SchemaContractError, match="orders_dataset.csv: missing file"):
        run_pipeline(spark, str(raw), str(tmp_path / "out"), SMALL_DATA)
    assert not (tmp_path / "out").exists()


def test_exports(run):
    assert len(run.exported) == 10
    for table, columns in EXPORT_COLUMNS.items():
        assert tuple(run.exported[table].columns) == columns
    assert not any("comment" in c for df in run.exported.values() for c in df.columns)
    written = sorted(rows(run.exported["fact_orders"]), key=lambda r: r["order_id"])
    assert written == sorted(rows(run.tables["fact_orders"]), key=lambda r: r["order_id"])
    index = keyed(rows(run.index), "file")
    assert len(index) == 12
    assert index["q01_monthly_orders_revenue"]["rows"] == 5
    counts = keyed(rows(run.load_summary), "table")
    assert counts["raw_orders"]["rows"] == 13
    assert counts["raw_reviews"]["rows"] == 9  # one of them holds a line break


def test_facts(run):
    found = keyed(rows(run.facts), "fact")
    assert len(found) == 46
    text = {name: line["text"] for name, line in found.items()}
    assert (text["period_start"], text["period_end"]) == ("Jan 2020", "May 2020")
    assert text["partial_months"] == "none" and text["generated_on"] == "2020-06-01"
    assert (text["delivered_orders"], text["revenue"], text["avg_order_value"]) == ("8", "915", "114")
    assert (text["review_gap"], text["review_gap_ci_low"], text["review_gap_ci_high"]) == (
        "2.50",
        "1.00",
        "4.00",
    )
    assert text["late_rate_pct"] == "50.0%"
    assert text["late_rate_pct_by_timestamp"] == "66.7%"  # o2 as well: 4 of 6
    assert text["worst_states"] == "RJ (100.0%), PE (100.0%), RS (0.0%)"
    assert (text["worst_state_codes"], text["what_if_state_count"]) == ("RJ, PE", "2")
    assert found["late_orders_avoided"]["value"] == 1.5  # (2 - 1) + (1 - 0.5)
    assert found["low_reviews_avoided"]["value"] == 1.5
    assert text["median_days_to_second_order"] == "21"
    assert (text["repeat_same_day_only"], text["repeat_same_day_only_pct"]) == ("1", "33.3%")
    assert (text["month1_retention_pct"], text["month1_cohorts"]) == ("40.0%", "3")
    assert found["revenue_per_repeat_point"]["value"] == pytest.approx(0.05 * 114.375)
    assert text["top3_categories"] == "furniture, beauty, pet"
    assert found["top3_revenue_share_pct"]["value"] == 56.34
    assert text["high_freight_categories"] == "pet (20.0%)"
    assert found["freight_reduction"]["value"] == pytest.approx(24 - 120 * 118 / 985, abs=1e-6)
    assert text["review_by_delay_buckets"] == (
        "On time or early 4.00 (n=3); 1-3 days late 2.00 (n=1); 8-14 days late 1.00 (n=1)"
    )
    assert "without a delivery date: 1; delivered before purchase: 1" in text["dq_summary"]


def test_facts_without_a_late_group(run):
    answers = run.tables.answers()
    sides = answers["review_late_vs_on_time"].filter("delivery_group = 'on_time'")
    (gap,) = rows(facts.review_gap_ci({"review_late_vs_on_time": sides}))
    assert gap["review_gap"] is None and gap["review_gap_ci_low"] is None
    changed = answers | {"review_late_vs_on_time": sides}
    found = keyed(
        rows(facts.memo_facts(changed, run.tables["dq_log"], SMALL_DATA, "x")), "fact"
    )
    assert found["low_review_pct_late"]["text"] == "0.0%"
    assert found["avg_review_late_answered_after_delivery"]["text"] == "n/a"
    assert found["review_gap"]["text"] is None


def test_cohort_grid_blanks_what_cannot_be_observed(run):
    answers = run.tables.answers()
    month = F.col("purchase_month")
    may = F.lit(datetime.date(2020, 5, 1))
    cut = answers["monthly_orders_revenue"].withColumn(
        "is_partial_month", F.when(month == may, 1).otherwise(F.col("is_partial_month"))
    )
    grid = keyed(rows(facts.cohort_grid(answers | {"monthly_orders_revenue": cut}, SMALL_DATA)),
                 "cohort_month")
    jan = grid[datetime.date(2020, 1, 1)]
    assert [jan[f"month_{m}"] for m in range(1, 7)] == [50, 0, 0, None, None, None]
    assert grid[datetime.date(2020, 3, 1)]["month_1"] == 50
    early = answers["monthly_orders_revenue"].filter(month < datetime.date(2020, 4, 1))
    grid = keyed(rows(facts.cohort_grid(answers | {"monthly_orders_revenue": early}, SMALL_DATA)),
                 "cohort_month")
    assert datetime.date(2020, 3, 1) not in grid  # no observable month


def test_dashboard_queries(run):
    answers = run.tables.answers()
    trend = rows(dashboard.monthly_trend(answers, "orders_placed"))
    assert [t["value"] for t in trend] == [3, 2, 2, 3, 1]
    best = rows(dashboard.category_ranking(answers, 2, "highest_review"))
    assert [b["category"] for b in best] == ["furniture", "beauty"]
    worst = rows(dashboard.category_ranking(answers, 1, "lowest_review"))
    assert [w["category"] for w in worst] == ["pet"]
    assert [s["customer_state"] for s in rows(dashboard.late_by_state_filtered(answers, 2))] == [
        "RJ",
        "RS",
    ]
    assert [r["retention_pct"] for r in rows(dashboard.retention_curve(answers, 1))] == [50, 50]
    with pytest.raises(ValueError):
        dashboard.monthly_trend(answers, "orders")
    with pytest.raises(ValueError):
        dashboard.category_ranking(answers, 3, "size")


def test_the_command_line_checks_files_only(tmp_path, capsys):
    from marketspark.__main__ import main

    raw = write_files(tmp_path / "raw", fixture.tables())
    assert main([str(raw), str(tmp_path / "out"), "--check-only"]) == 0
    Path(raw / "shop_sellers_dataset.csv").write_text("seller_id,seller_city\ns1,x\n")
    assert main([str(raw), str(tmp_path / "out"), "--check-only"]) == 1
    assert "missing columns: seller_zip_code_prefix, seller_state" in capsys.readouterr().err


def test_facts_are_exported_by_month(run, tmp_path_factory):
    for name, fmt in (("fact_orders", "csv"), ("fact_payments", "parquet"), ("dim_seller", "csv")):
        out = tmp_path_factory.mktemp("export")
        again = export_table(run.tables.model(), {}, name, str(out), fmt)
        folders = {p.name.split("=")[0] for p in (out / name).iterdir() if p.is_dir()}
        assert folders == (set() if name.startswith("dim") else {"purchase_month"})
        assert again.columns == list(EXPORT_COLUMNS[name])
        stored = run.tables[name].select(*again.columns)
        assert sorted(map(str, again.collect())) == sorted(map(str, stored.collect()))


def test_command_line_tells_what_differs(spark, tmp_path, capsys):
    raw = write_files(tmp_path / "raw", fixture.tables())
    assert main([str(raw), str(tmp_path / "out")]) == 2
    printed = capsys.readouterr()
    assert "quality checks have findings" in printed.out
    assert "mismatch  revenue: " in printed.err and printed.err.count("mismatch") >= 2
    with pytest.raises(SystemExit):
        main([str(raw), str(tmp_path / "out"), "--free-text", "reviews,nothing"])
