"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a local master may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder")
    path = f"{(root or tempfile.mkdtemp(prefix='gradeflow-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    """What a query left goes when the driver ends."""
    try:
        if spark.sparkContext._jsc is not None:
            fs, target = file_system(spark, path)
            fs.delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


def file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that what it takes to make it is done once; it goes when the driver ends."""
    path = shared_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
