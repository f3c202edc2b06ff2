"""CSV files whose fields hold line breaks, read by many tasks.

Spark splits a text file into byte ranges of whole lines. Whether a line begins inside quotes depends on
all lines before it, so each line is taken as a function of that one bit: a line without quotes keeps it, one
that opens or closes a field turns or sets it. The first scan composes the functions of each range into one row, with the
lines at its two edges; running over the ranges of a file, these rows tell which ranges begin inside
quotes and which lines belong to a record that crosses an edge. The second scan cuts every range into whole
records on its own, and Spark's CSV parser reads each. No text is shuffled but the records that cross edges.

Both scans must split the files alike. Spark's split size depends on the number of cores, so
`spark.sql.files.minPartitionNum` is set where it is unset; a range that the first scan did not see is an error.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: A field that ends on its line, quoted or not; quotes inside quotes are doubled.
_FIELD = r'(?:[^",][^,]*|"(?:[^"]|"")*"[^",]*)?'
_OPEN = r'"(?:[^"]|"")*$'
#: Is the end of a line inside quotes, if its beginning is outside, or inside?
OPENS = f"^(?:{_FIELD},)*{_OPEN}"
STAYS = rf'^(?:[^"]|"")*$|^(?:[^"]|"")*"[^",]*,(?:{_FIELD},)*{_OPEN}'

MIN_PARTITIONS = "spark.sql.files.minPartitionNum"
#: Of its file a line has a digest, which is shorter than the path; ranges of two files that share one are an error.
RANGE = "file long, start long"
EDGES = f"{RANGE}, crlf boolean, from_outside boolean, from_inside boolean, tail binary, closes boolean, head_outside binary, head_inside binary"


class Cutter:
    """Cuts the lines of one range into records, from a known state at its beginning.

    `tail` are the lines before the first record that begins here, `pending` those of the last one so far.
    """

    def __init__(self, inside: bool):
        self.inside = inside  # at the end of what was fed
        self.begun = not inside
        self.tail: list[bytes] = []
        self.pending: list[pa.Array] = []

    def states(self, opens: np.ndarray, stays: np.ndarray) -> np.ndarray:
        """Is the beginning of each line inside quotes? The state before the first line is `inside`."""
        turns = np.concatenate([[0], np.cumsum(opens & ~stays)])
        sets = opens == stays
        last = np.maximum.accumulate(np.where(sets, np.arange(len(opens)), -1))
        last = np.concatenate([[-1], last])
        base = np.where(last >= 0, opens[np.maximum(last, 0)], self.inside)
        since = turns - np.where(last >= 0, turns[np.maximum(last, 0) + 1], 0)
        return base ^ (since % 2 == 1)

    def feed(self, lines: pa.Array, opens: np.ndarray, stays: np.ndarray, records: bool = True) -> list[pa.Array]:
        """Whole records that end here, as arrays of bytes; none are put together without `records`."""
        if not len(lines):
            return []
        state = self.states(opens, stays)
        self.inside = bool(state[-1])
        starts = np.flatnonzero(~state[:-1])
        if not len(starts):
            self._keep(lines)
            return []
        out = []
        first, last = int(starts[0]), int(starts[-1])
        if first:
            self._keep(lines.slice(0, first))
        if self.begun and self.pending and records:
            out.append(joined(pa.concat_arrays(self.pending), [0]))
        self._close()
        if self.inside:  # the last record goes on
            if records and last > first:
                out.append(joined(lines.slice(first, last - first), starts[:-1] - first))
            self.pending = [lines.slice(last)]
        elif records:
            out.append(joined(lines.slice(first), starts - first))
        return out

    def _keep(self, lines: pa.Array) -> None:
        self.pending.append(lines)

    def _close(self) -> None:
        if not self.begun:
            self.tail, self.begun = self.pending, True
        self.pending = []

    def finish(self) -> list[pa.Array]:
        """The last record, if it is whole."""
        if self.inside:
            return []
        out = [joined(pa.concat_arrays(self.pending), [0])] if self.begun and self.pending else []
        self._close()
        return out


def joined(lines: pa.Array, starts) -> pa.Array:
    """Lines between starts put together with line breaks."""
    starts = np.asarray(starts)
    if len(starts) == len(lines):
        return lines
    offsets = pa.array(np.append(starts, len(lines)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines), pa.scalar(b"\n", lines.type))


def edge(lines: list[pa.Array]) -> bytes | None:
    return joined(pa.concat_arrays(lines), [0])[0].as_py() if lines else None


def line_functions(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(opens, stays) of each line, as OPENS and STAYS say."""
    opens, stays = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.flatnonzero(pc.greater(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False))
    if len(quoted):
        some = lines.take(pa.array(quoted))
        opens[quoted] = pc.match_substring_regex(some, OPENS).to_numpy(zero_copy_only=False)
        stays[quoted] = pc.match_substring_regex(some, STAYS).to_numpy(zero_copy_only=False)
    return opens, stays


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(file, start, rows) of one range at a time; a range may come in several pieces."""
    for batch in batches:
        file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield int(file[a]), int(start[a]), batch.slice(a, b - a)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range of the task."""
    key, both, crlf = None, (), None

    def row() -> pa.RecordBatch:
        outside, inside = both
        values = (*key, crlf, outside.inside, inside.inside, edge(inside.tail if inside.begun else inside.pending), inside.begun)
        values += (edge(outside.pending) if outside.inside else None, edge(inside.pending) if inside.begun and inside.inside else None)
        kinds = (pa.int64(), pa.int64(), *[pa.bool_()] * 3, pa.binary(), pa.bool_(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in EDGES.split(", ")])

    for file, start, rows in _ranges(batches):
        if (file, start) != key:
            if key:
                [c.finish() for c in both]
                yield row()
            key, both = (file, start), (Cutter(False), Cutter(True))
            crlf = rows.column(2)[0].as_py().endswith("\r") if start == 0 else None
        lines = rows.column(2).cast(pa.binary())
        functions = line_functions(lines)
        for cutter in both:
            cutter.feed(lines, *functions, records=False)
    if key:
        [c.finish() for c in both]
        yield row()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin and end in one range, without the header of each file."""
    key, cutter, header, crlf = None, None, False, False

    def out(found: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        nonlocal header
        for records in found:
            if header and len(records):
                records, header = records.slice(1), False
            if crlf:  # of two characters, also inside quotes, as Spark's own reader does
                records = pc.replace_substring_regex(pc.replace_substring(records, "\r\n", "\n"), "\r$", "")
            if len(records):
                yield pa.RecordBatch.from_arrays([records], ["record"])

    for file, start, rows in _ranges(batches):
        if (file, start) != key:
            if key:
                yield from out(cutter.finish())
            key, cutter, header = (file, start), Cutter(rows.column(3)[0].as_py()), start == 0
            crlf = rows.column(4)[0].as_py()
        lines = rows.column(2).cast(pa.binary())
        yield from out(cutter.feed(lines, *line_functions(lines)))
    if key:
        yield from out(cutter.finish())


def _lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    if not spark.conf.get(MIN_PARTITIONS, None):
        spark.conf.set(MIN_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    text = spark.read.text(paths, lineSep="\n", recursiveFileLookup=True, pathGlobFilter="*.csv")
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def range_edges(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row for each byte range: the state at its end from either state at its beginning, the lines before its
    first record (`closes`: if one begins here at all), and those of its last record if that goes on."""
    return _lines(spark, paths).mapInArrow(_composed, EDGES)


def states_of(edges: DataFrame) -> DataFrame:
    """The edges with `inside`: does the range begin inside quotes? `crlf` is that of the whole file, by its first line. A window
    has the ranges of one file."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    twice = F.count(F.lit(1)).over(Window.partitionBy("file", "start")) > 1
    edges = edges.withColumn("start", F.when(twice, F.raise_error(F.lit("two files share a digest")).cast("long")).otherwise(F.col("start")))
    sets = F.col("from_outside") == F.col("from_inside")
    turns = F.coalesce(F.sum(F.when(~sets & F.col("from_outside"), 1).otherwise(0)).over(before), F.lit(0))
    upto = turns + F.when(~sets & F.col("from_outside"), 1).otherwise(0)
    known = edges.withColumns({"turns": turns, "last": F.when(sets, F.struct(F.col("from_outside").alias("state"), upto.alias("turns")))})
    last = F.last("last", ignorenulls=True).over(before)
    base = F.coalesce(last["state"], F.lit(False))
    odd = (F.col("turns") - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    crlf = F.max("crlf").over(Window.partitionBy("file"))
    return known.withColumns({"inside": base != odd, "crlf": F.coalesce(crlf, F.lit(False))}).drop("turns", "last")


def crossing_records(states: DataFrame) -> DataFrame:
    """(record) of the records that cross an edge: heads, ranges inside one, tails, put together in order."""
    order = Window.partitionBy("file").orderBy("start", "side")
    inside = F.col("inside")
    head = F.when(inside, F.col("head_inside")).otherwise(F.col("head_outside"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.when(inside, F.col("tail")).alias("text"), F.lit(False).alias("head")),
        F.struct(F.lit(1).alias("side"), head.alias("text"), F.lit(True).alias("head")),
    )
    pieces = states.select("file", "start", "crlf", F.inline(sides)).where("text is not null")
    chained = pieces.withColumn("record_no", F.count_if("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.sort_array(F.collect_list(F.struct("start", "side", F.col("text").cast("string").alias("text"))))
    text = F.array_join(F.transform(texts, lambda t: t["text"]), "\n")
    whole = chained.groupBy("file", "record_no", "crlf").agg(text.alias("text"))
    plain = F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\r$", "")
    return whole.select(F.when(F.col("crlf"), plain).otherwise(F.col("text")).alias("record"))


def free_text_records(spark: SparkSession, paths: list[str] | str, edges: DataFrame) -> DataFrame:
    """(record) of every record but the headers. `edges` is the stored result of `range_edges`."""
    states = states_of(edges)
    # at most one short row for each byte range of the files, of which there are few for each gigabyte
    begins = F.broadcast(states.select(F.col("file").alias("_file"), F.col("start").alias("_start"), "inside", "crlf"))
    lines = _lines(spark, paths)
    known = lines.join(begins, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")), "left")
    unseen = F.raise_error(F.lit(f"files were split anew since they were scanned; set {MIN_PARTITIONS}"))
    inside = F.when(F.col("inside").isNull(), unseen.cast("boolean")).otherwise(F.col("inside"))
    whole = known.select("file", "start", "value", inside.alias("inside"), "crlf").mapInArrow(_whole, "record binary")
    return whole.select(F.col("record").cast("string").alias("record")).unionByName(crossing_records(states))


def parsed(records: DataFrame, columns: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    """Records as columns of text, by Spark's CSV parser. Blank lines are no records."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    row = F.from_csv("record", schema, {**options, "multiLine": "true", "mode": "PERMISSIVE"})
    return records.where("record <> ''").select(row.alias("row")).select("row.*")
