"""What the operators share: the tables, the shared folder, bounded Arrow batches and deterministic folds."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.ship import ship_package

#: Rows of one Arrow batch. Texts can be 100 kB each, so the default of 10,000 rows could be a GB.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows``, so that a Python worker's memory has a bound.

    The setting stays lowered: plans read it when they run, after the operator has returned.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: a fold that no other column influences."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The columns of ``df`` but ``names``, which Spark takes as equal in any case."""
    return [c for c in df.columns if c.lower() not in names]


def release() -> None:
    """Give memory of what the driver has dropped back to the system: allocators keep it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder")
    root = tempfile.mkdtemp(prefix="gradeflow-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def with_fields(df: DataFrame, fields: str) -> StructType:
    """The schema of ``df`` with further nullable fields, such as ``"tokens array<int>, n long"``."""
    more = StructType.fromDDL(fields)
    return StructType([StructField(f.name, f.dataType, True) for f in [*df.schema.fields, *more.fields]])


class Scratch:
    """Tables of one run, written to the shared folder: they cut lineage and survive the loss of executors.

    ``drop`` deletes a table that nothing needs any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            pass
