"""Shared folder for intermediate tables, checkpoints and stream outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a temporary folder. A cluster
    without a shared folder is refused, because executors could not see each other's files.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="pulsecart-")
    spark.conf.set(_SETTING, folder)
    return folder


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def write_tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks that write ``rows`` rows, about ``each`` of them in a file, and two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))


def materialise(df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors. It also gives Spark the true size of
    the result, so a later join is broadcast only when the written files are below
    ``spark.sql.autoBroadcastJoinThreshold`` and is a shuffled join otherwise.

    With ``tasks``, more partitions than that are written by so many tasks, one partition after
    another. Every file costs its executor child processes on a local folder (Hadoop sets rights by
    them), and the open files of the next step.
    """
    if tasks is not None:
        df = df.coalesce(tasks)
    path = run_folder(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
