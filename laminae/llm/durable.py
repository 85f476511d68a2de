"""Cutting lineage in storage that every executor can read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where it is unset, in local mode alone, a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="laminae-checkpoint-")
        atexit.register(shutil.rmtree, configured, True)
    sc.setCheckpointDir(configured)


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder; losing an executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Narrow rows that are worth a task of their own, and tasks that are always allowed.
ROWS_A_TASK, LEAST_TASKS = 50_000, 8


def compact(df: DataFrame) -> tuple[DataFrame, int]:
    """``durable`` for narrow rows, and their number: few rows are read by few tasks afterwards.

    A shuffle leaves files for each task that feeds it, so hundreds of nearly empty tasks in each of
    many small steps cost more disk than the rows.
    """
    df = durable(df)
    rows = df.count()
    return df.coalesce(max(LEAST_TASKS, -(-rows // ROWS_A_TASK))), rows


def write_table(df: DataFrame) -> str:
    """Write ``df`` as a Parquet table in the shared checkpoint folder: for wide rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def remove_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
