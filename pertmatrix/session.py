"""Session helpers: a local session for tests and benches, and shared scratch space."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "pertmatrix") -> SparkSession:
    """A local[N] session. On a cluster, pass your own session to the operators instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@functools.cache
def _local_root() -> str:
    """One folder per process, for tests without spark.checkpoint.dir."""
    return tempfile.mkdtemp(prefix="pertmatrix-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    A local master without that setting gets a temporary folder; a cluster without it is an
    error, because executors could not see a folder of the driver's machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/pertmatrix/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to shared scratch space and read back.

    For small aggregates that several branches of a plan use: the pass over the entries behind
    them runs once, and lost executors cost only the unfinished part.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_width(spark: SparkSession) -> int:
    """How many tasks a small table that is about to grow is spread over."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = spark.sparkContext.master.startswith("local")
    return min(parts, spark.sparkContext.defaultParallelism) if local else parts
