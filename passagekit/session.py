"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "passagekit", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on; further settings come from the caller or the cluster."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


# Rows and bytes per Arrow batch: what a Python worker holds follows neither the number of rows nor the size of pages. A larger row is a batch.
ARROW_ROWS, ARROW_BYTES = 2000, 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session ready for the operators.

    The executors' Python workers get this package, wherever it lies on the driver (once per
    context), and Arrow batches of long texts get a bound.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ARROW_ROWS:
        spark.conf.set(setting, ARROW_ROWS)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(setting)) <= ARROW_BYTES:
        spark.conf.set(setting, ARROW_BYTES)
    context = spark.sparkContext
    if not getattr(context, "_passagekit_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="passagekit-"), f"passagekit-{uuid.uuid4().hex}"), "zip",
            os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        context._passagekit_shipped = True
    return spark


def _bytes(size: str) -> int:
    """A size as Spark's settings have it; without a unit it is in bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A temporary one is set only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = context.getCheckpointDir()
        if folder is None:
            folder = tempfile.mkdtemp(prefix="passagekit-")
            context.setCheckpointDir(folder)
            folder = context.getCheckpointDir()
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several later jobs read as Parquet, and go on from the written copy, which keeps column pruning."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, bytes_per_core: int = 32 << 20) -> DataFrame:
    """Use all cores for a table that is too small to be split by the reader.

    A file with one row group is read by one task. Tables of real size have many splits and pass
    through without a shuffle; the size is the optimizer's own estimate.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * bytes_per_core else df


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own estimate of a table's size; it runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
