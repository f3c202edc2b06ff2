"""CSV to all-text tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.sources.contract import CONTRACT, FREE_TEXT, Header, headers_of, normalise_columns, paths_with
from marketspark.sources.records import free_text_records, parsed, range_edges
from marketspark.sources.store import new_folder, read_back, write_table

#: Fields may be quoted, with quotes doubled inside.
QUOTING = {"quote": '"', "escape": '"'}
#: A longer file with line breaks in fields is cut into records by many tasks. They do more work for each byte than
#: one task that reads a whole file, so short files are not cut: those are spread over tasks anyway.
CUT_ABOVE = 512 << 20


def _read(
    spark: SparkSession, paths: list[str], header: Header, multi_line: bool, cut_above: int
) -> DataFrame:
    """CSV files that share a header, every column as text. Files with line breaks inside fields are read
    whole, one by each task, or cut into records by many if one of them is longer than `cut_above` bytes."""
    if multi_line and header.largest > cut_above:
        edges, folder = range_edges(spark, paths), new_folder(spark, "edges")
        write_table(edges, folder)
        return parsed(free_text_records(spark, paths, read_back(spark, folder, edges)), header.columns, QUOTING)
    schema = ", ".join(f"`{c}` string" for c in header.columns)
    return spark.read.csv(paths, schema=schema, header=True, multiLine=multi_line, **QUOTING)


def _frames(
    spark: SparkSession, path: str, headers: list[Header], multi_line: bool, cut_above: int = CUT_ABOVE
) -> list[tuple[Header, DataFrame]]:
    """Each different header of a file or of the parts of a folder, with the rows below it."""
    one = len(headers) == 1  # the folder in the plan instead of all its parts
    return [(h, _read(spark, [path] if one else paths_with(spark, path, h), h, multi_line, cut_above)) for h in headers]


def read_raw(
    spark: SparkSession,
    path: str,
    table: str | None = None,
    multi_line: bool | None = None,
    cut_above: int = CUT_ABOVE,
    headers: list[Header] | None = None,
) -> DataFrame:
    """One CSV file, or a folder of parts, with every column as text under normalised names.

    Parts are grouped by their headers, so columns may stand in another order in each part. Quoted
    line breaks are read only with `multi_line`; the default asks for it where the table holds free
    text, or where no table is named. Such files are read by one task each if all are at most `cut_above` bytes
    long, else they are cut at record ends (`records`). All other files
    are split by Spark. `headers` are those of `headers_of`, if they are known. With `table`, the contract's columns come in the contract's order and
    extra ones are left out; without it, all parts must have the same columns. Blank fields are NULL.
    """
    if multi_line is None:
        multi_line = table is None or table in FREE_TEXT
    known = headers_of(spark, {"": path})[""] if headers is None else headers
    found = _frames(spark, path, known, multi_line, cut_above)
    if not found:
        raise ValueError(f"{path} has no header")
    wanted = CONTRACT[table][1] if table else found[0][0].columns
    frames = []
    for header, rows in found:
        if not set(wanted) <= set(header.columns) or not table and set(header.columns) != set(wanted):
            raise ValueError(f"{path} has a part with the columns {list(header.columns)}, not {list(wanted)}")
        frames.append(rows.select(*wanted))
    return normalise_columns(reduce(DataFrame.unionByName, frames))


def read_all(
    spark: SparkSession, files: dict[str, str], free_text: Collection[str] = FREE_TEXT
) -> dict[str, DataFrame]:
    """All tables; those named in `free_text` may hold line breaks inside fields."""
    headers = headers_of(spark, files)  # of all tables in one job
    return {
        table: read_raw(spark, path, table, table in free_text, headers=headers[table]) for table, path in files.items()
    }


def load_summary(raw: dict[str, DataFrame], known: Mapping[str, int] | None = None) -> DataFrame:
    """(table, rows) of each loaded table: counts only, one small row from each. `known` numbers are not counted again."""
    known = known or {}
    counts = [
        df.sparkSession.range(1).select(F.lit(f"raw_{name}").alias("table"), F.lit(known[name]).cast("bigint").alias("rows"))
        if name in known
        else df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"raw_{name}").alias("table"), "rows")
        for name, df in raw.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def part_report(spark: SparkSession, files: dict[str, str], free_text: Collection[str] = FREE_TEXT) -> DataFrame:
    """(table, file, missing, rows) for each different header among the parts of each table.

    `missing` lists the contract's columns that the header lacks; `rows` counts the lines of all
    parts that have it.
    """
    counts, headers = [], headers_of(spark, files)
    for table, path in files.items():
        by_missing: dict[str, list[DataFrame]] = {}
        for header, rows in _frames(spark, path, headers[table], table in free_text):
            missing = ", ".join(c for c in CONTRACT[table][1] if c not in header.columns)
            by_missing.setdefault(missing, []).append(rows.select(F.lit(1).alias("one")))
        for missing, lines in by_missing.items():
            counted = reduce(DataFrame.unionByName, lines).agg(F.count("one").alias("rows"))
            name = path.rstrip("/").rpartition("/")[2]
            counts.append(
                counted.select(
                    F.lit(table).alias("table"), F.lit(name).alias("file"), F.lit(missing).alias("missing"), "rows"
                )
            )
    return reduce(DataFrame.unionByName, counts)
