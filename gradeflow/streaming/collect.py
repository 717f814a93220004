"""Collecting finished records as a stream: files of records in, each record once out, whatever is restarted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import file_system

#: Column that says in which batch a record came.
BATCH = "_batch"


def arriving(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    """The records of JSON files as they arrive in ``folder``; a malformed line ends the stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("mode", "FAILFAST").json(folder)


def collect(records: DataFrame, target: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Start writing a stream of records to ``target``; by default all there is now, then the stream ends.

    A batch is written to a folder of its own name, which a batch that runs again after a crash writes anew: the
    checkpoint says which files a batch has, so what is there twice is never counted twice. ``after`` is called with
    each batch once it is written, and must bear being called again.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")
        if after:
            after(batch, number)

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def collected(spark: SparkSession, target: str, schema: str, key: str) -> DataFrame:
    """The records so far, each key once: of a key that was produced again the one that came last."""
    fs, path = file_system(spark, target)
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {BATCH} long").parquet(target)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), BATCH).alias("_r")).select(key, "_r.*").drop(BATCH)
