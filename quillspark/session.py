"""Small helpers around a SparkSession."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, if their environment doesn't name it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    if root not in (paths := environment.get("PYTHONPATH", "").split(":")):
        environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder, where its lineage ends. A local master gets a folder where none is named; its tasks all see it."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def heavy_tasks(spark: SparkSession) -> int:
    """Into how many tasks rows are dealt that cost much more time than bytes: adaptive execution, which goes by bytes, would put many such rows into a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


#: Rows of a task that sorts or groups narrow rows of some hundred bytes several times.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Into how many tasks df is dealt so that a task's rows stay about as many however large df is; it is counted for that."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
