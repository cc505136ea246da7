"""Helpers shared by the operators: lineage cuts, and the measured choice between a broadcast and a shuffle join."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many bytes, as counted before the join, may be broadcast.
BROADCAST_BYTES = 8 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for materialised steps: what the session names in spark.checkpoint.dir.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that a lost executor costs only a reread."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_narrow(df: DataFrame) -> DataFrame:
    """cut for rows of a few numbers, in a few files for each core instead of one for each shuffle partition: Hadoop starts a
    process for every file that it makes on a local file system, and for its duration that process counts as large as its JVM."""
    spark = df.sparkSession
    few = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    return cut(df.coalesce(few))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is materialised inside: rows that carry texts are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted rows stay under BROADCAST_BYTES, else df itself.

    Beyond the bound the join is left to Spark: a sort-merge join whose skewed
    partitions adaptive execution splits.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_by(df: DataFrame, row_bytes: Column) -> DataFrame:
    """The same for rows of different size: the bytes of all rows are summed before the join."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df
