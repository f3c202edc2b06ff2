"""python -m marketspark RAW_DIR OUT_DIR [--check-only]: exit 0 all reconciled, 1 files, 2 mismatch."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from marketspark.plans.pipeline import run_pipeline
from marketspark.sources.contract import CONTRACT, FREE_TEXT, SchemaContractError, require_contract


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marketspark")
    parser.add_argument("raw_dir")
    parser.add_argument("out_dir")
    parser.add_argument("--check-only", action="store_true")
    parser.add_argument("--label", default="")
    parser.add_argument(
        "--free-text",
        default=",".join(sorted(FREE_TEXT)),
        help="tables whose fields may hold line breaks, separated by commas; the files of others are split",
    )
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("marketspark").getOrCreate()
    try:
        if args.check_only:
            require_contract(spark, args.raw_dir)
            print("all files are there, with the columns they need")
            return 0
        free_text = [name for name in args.free_text.split(",") if name]
        if unknown := set(free_text) - set(CONTRACT):
            parser.error(f"no such tables: {', '.join(sorted(unknown))}")
        result = run_pipeline(spark, args.raw_dir, args.out_dir, label=args.label, free_text=free_text)
    except SchemaContractError as error:
        print(error, file=sys.stderr)
        return 1
    print(f"{result.findings()} quality checks have findings: {args.out_dir}/dq_log")
    mismatches = result.mismatches()
    for line in mismatches:
        print(f"mismatch  {line}", file=sys.stderr)
    if not mismatches:
        print("all totals reconcile")
    return 2 if mismatches else 0


if __name__ == "__main__":
    sys.exit(main())
