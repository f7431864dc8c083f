"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one where that is unset.

    On a cluster an unset folder is an error: a machine-local one would lose data with its machine.
    """
    found = spark.conf.get(SETTING, None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='storyspark-')}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back.

    Later readers see the written rows, whatever executors are lost; column pruning and the exact
    size of the files are available to the optimizer. The files go when the session ends, or
    earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._storyspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``materialize`` result that nothing reads any more."""
    if path := getattr(df, "_storyspark_path", None):
        p, fs = _path(df.sparkSession, path)
        fs.delete(p, True)
