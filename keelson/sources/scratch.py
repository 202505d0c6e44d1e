"""Tables that jobs write between steps, in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``. A session on one machine may leave
    that unset; elsewhere it is an error, for machines don't see each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "/tmp/keelson-checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to a new shared folder and read back: later steps start from its
    files, whatever executors are lost meanwhile."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any store that Spark reaches."""
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that it holds, if it is there."""
    fs, where = _at(spark, path)
    fs.delete(where, True)
