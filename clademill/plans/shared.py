"""Cutting lineage in iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A local master gets its own folder where the setting is missing; a cluster is
    refused, since other executors could not read a machine's own folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, in one job."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._checkpoint_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the files of tables that :func:`checkpoint` returned."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._checkpoint_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """A number for exchanges of few rows with much work each, which adaptive execution would merge into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
