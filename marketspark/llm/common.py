"""Shared helpers: narrow inputs, Arrow batches of bounded size, folders and stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marketspark.sources.store import drop_folder, store_root

SLICE_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns are neither read nor able to clash. A null text is empty."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def map_slices(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over slices of a few hundred rows, so a task holds few texts as Python objects.

    `work` is called once in each task and returns the function for a slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield each(batch.slice(start, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def text_function(work: Callable[[], Callable[[list[str | None]], pa.Array]], returns: T.DataType) -> Callable[[Column], Column]:
    """A column function of a text column, on slices of a few hundred rows of an Arrow batch.

    `work` is called once in each task and returns the function from a list of texts to an array.
    """
    kind = to_arrow_type(returns)

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = work()
        for batch in batches:
            parts = [each(batch.slice(i, SLICE_ROWS).to_pylist()) for i in range(0, len(batch), SLICE_ROWS)]
            yield pa.concat_arrays([part.cast(kind) for part in parts]) if parts else pa.array([], kind)

    return run


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared place that the session names."""
    return f"{store_root(spark)}/llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that one step needs and that can be dropped once its result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def store(self, df: DataFrame, label: str) -> DataFrame:
        path = folder(self.spark, label)
        self.folders.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables; what was read from them and not stored can't be read afterwards."""
        while self.folders:
            drop_folder(self.spark, self.folders.pop())
