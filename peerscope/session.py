"""Session settings the engine relies on."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
JOINED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
DEALT_BYTES = 1 << 20  # bytes of files for each part of a shuffle
MOST_PARTS = 4_000
JOINED_BYTES = 4 << 20  # AQE puts parts together up to these bytes: a match's rows become hundreds inside a task


def build_session(app: str = "peerscope", cores: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    n = cores or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PEERSCOPE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator assumes: weeks and days are UTC."""
    if spark.conf.get("spark.sql.session.timeZone", "") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def parts(spark: SparkSession) -> int:
    """The parts that shuffles start with."""
    return int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def deal(spark: SparkSession, paths: Sequence[str]) -> None:
    """Let shuffles start with a part for every ``DEALT_BYTES`` of the tables: a fixed number of parts would grow with them.

    Only ever raises the number. AQE puts small parts together again, but no larger than ``JOINED_BYTES``: it goes by the
    bytes shuffled, while the sorts and sums of a task hold what is made of them.
    """
    size = 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    n = min(size // DEALT_BYTES, MOST_PARTS)
    if n > parts(spark):
        spark.conf.set(INITIAL, str(n))
        if spark.conf.get(JOINED, None) is None:
            spark.conf.set(JOINED, str(JOINED_BYTES))
