"""Stored tables: where they live, how they are written, and a lake that builds each one once.

Tables go to the shared folder that the session names in `spark.checkpoint.dir`, so a lost executor
only costs a re-read. Without that setting nothing is stored: a folder of one machine would not do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import RLock

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables that are stored with a folder for each month, which date slicers prune.
STORED_BY_MONTH = ("fact_orders",)
PARTITION_COLUMN = "purchase_month"

#: Tables that meet others by a key, stored in buckets by it, so that joins on the key read them without a
#: shuffle. No key is hot in them: tables where one order may have very many rows are not bucketed, so lines of such
#: orders are a table of their own.
BUCKETED = {"clean_orders": "order_id", "clean_reviews": "order_id", "calm_order_items": "order_id"}

#: Stored tables are read a few times at most, so they are packed tighter than Spark's default.
PACKED = {"compression": "zstd"}

#: With it, the files of a shuffle are deleted when the query that made them ends. Without, they stay until the driver
#: happens to collect garbage, so the shuffles of all tables of a run may lie on the disks at once.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class NoSharedFolder(Exception):
    """The session names no folder that all executors share."""


def store_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    context = spark.sparkContext
    shared = (
        context.getConf().get("spark.checkpoint.dir")
        or spark.conf.get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if not shared:
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared.rstrip("/")


def drop_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a folder of stored tables that is no longer needed; False if there was none.

    Only folders below the shared folder of the session can be dropped.
    """
    root = store_root(spark)
    if not folder.startswith(f"{root}/") or ".." in folder:
        raise ValueError(f"{folder} is not below {root}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{store_root(spark)}/marketspark/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, name: str = "") -> None:
    """Write Parquet. The fact of orders is partitioned by month; REBALANCE gathers a month into few files and splits a
    month that is too large for one task, so a hot month does not become one writer. Other rows are written by the tasks
    that make them: facts of lines are shuffled to lie together by month only where they are exported.
    """
    if name in STORED_BY_MONTH:
        gathered = df.hint("rebalance", F.col(PARTITION_COLUMN))
        gathered.write.mode("overwrite").options(**PACKED).partitionBy(PARTITION_COLUMN).parquet(path)
    else:
        df.write.mode("overwrite").options(**PACKED).parquet(path)


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> str:
    """Write Parquet in buckets by a key; the name of the table that knows of them. Spark keeps buckets in its catalog."""
    table = f"lake_{uuid.uuid4().hex}"
    df.write.format("parquet").options(**PACKED).bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return table


def read_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read with the schema that was written: no inference, same column order."""
    return spark.read.schema(like.schema).parquet(path).select(like.columns)


#: Jobs that run at the same time.
MOST_JOBS = 16

#: Rows of one whole number that a task may hold as a table, about 100 MB.
MOST_BROADCAST = 2**21


def side_by_side(spark: SparkSession, work: Callable, names: Iterable[str]) -> list:
    """Run independent jobs at the same time, so the last tasks of one leave no executor idle."""
    names = list(names)
    if len(names) < 2:
        return [work(name) for name in names]
    with ThreadPoolExecutor(min(len(names), MOST_JOBS), "job") as threads:
        return list(threads.map(inheritable_thread_target(spark)(work), names))


class Lake:
    """Tables by name, each built on first use from the tables before it, written, and re-read.

    `builders` maps a name to a function of the lake. Names in `views` stay lazy plans. `buckets` is the number of
    buckets of the tables in BUCKETED: by default that of shuffle partitions, which the other sides of joins have; with 0
    no table needs the catalog. `observed` names counts that are taken of a table while it is written; they are found in
    `seen`. The tasks that write a table count once each, however often one is tried; tasks before a shuffle, which may run
    again after an executor is lost, would not, so counts are of the written rows only.
    """

    def __init__(
        self,
        spark: SparkSession,
        builders: dict[str, Callable[[Lake], DataFrame]],
        views: frozenset[str] = frozenset(),
        folder: str | None = None,
        buckets: int | None = None,
        observed: dict[str, dict[str, Column]] | None = None,
    ):
        self.spark = spark
        self._observed = observed or {}
        self.seen: dict[str, dict[str, int]] = {}  # what was counted while a table was written
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
        self._tables: list[str] = []
        self.folder = folder or new_folder(spark, "lake")
        self._builders = builders
        self._views = views
        self._ready: dict[str, DataFrame] = {}
        self._locks = {name: RLock() for name in builders}
        if spark.conf.get(SHUFFLES_END, None) is None:
            spark.conf.set(SHUFFLES_END, "true")

    def __getitem__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._ready:
                df = self._builders[name](self)
                if name not in self._views:
                    df = self._store(df, name)
                self._ready[name] = df
            return self._ready[name]

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        path, counts = f"{self.folder}/{name}", self._observed.get(name)
        if counts:
            observation = Observation()
            found = df.observe(observation, *[c.alias(n) for n, c in counts.items()])
            write_table(found, path, name)
            self.seen[name] = observation.get
            return read_back(self.spark, path, df)
        if name in BUCKETED and self.buckets:
            self._tables.append(write_buckets(df, path, BUCKETED[name], self.buckets))
            return self.spark.table(self._tables[-1]).select(df.columns)
        write_table(df, path, name)
        return read_back(self.spark, path, df)

    def plain(self, name: str) -> DataFrame:
        """A stored table without its buckets, for whoever gains nothing from them: its files are then read in even parts."""
        df = self[name]
        return df if name in self._views else read_back(self.spark, f"{self.folder}/{name}", df)

    def ready(self, name: str) -> bool:
        """Whether a table is there already."""
        return name in self._ready

    def is_few(self, name: str) -> bool:
        """Whether a table was seen to have few enough rows to be broadcast when it was written."""
        return self.seen.get(name, {}).get("rows", MOST_BROADCAST + 1) <= MOST_BROADCAST

    def few(self, name: str) -> DataFrame:
        """A table of one number a row, to be broadcast if that is known to be possible."""
        df = self[name]
        return F.broadcast(df) if self.is_few(name) else df

    def __contains__(self, name: str) -> bool:
        return name in self._builders

    def together(self, *names: str) -> list[DataFrame]:
        """Tables in the given order; those not yet there are built concurrently."""
        missing = [n for n in names if n not in self._ready]
        side_by_side(self.spark, self.__getitem__, missing)
        return [self[name] for name in names]

    def drop(self) -> bool:
        """Delete the stored tables; the lake can't be read afterwards."""
        self._ready.clear()
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        return drop_folder(self.spark, self.folder)

    def pick_as(self, names: dict[str, str]) -> dict[str, DataFrame]:
        """Tables under other names."""
        return dict(zip(names, self.together(*names.values()), strict=True))

    def pick(self, *names: str) -> dict[str, DataFrame]:
        return dict(zip(names, self.together(*names), strict=True))
