"""Session settings for local runs; on a cluster the job uses the session it is given."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession


def local_session(cpus: str | None = None, **extra: str) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marketspark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    if "spark.checkpoint.dir" not in extra and not SparkConf().get("spark.checkpoint.dir"):
        # one machine is all there is here, so its temporary folder is shared
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="marketspark-")
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
