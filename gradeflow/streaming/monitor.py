"""Streams of finished records: rates over event time, and resuming by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(events: DataFrame, at: str, bad: Column, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Share of bad records in each window of event time; works on batches and on streams with late rows."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    out = timed.groupBy(F.window(at, window)).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return out.select(F.col("window.start").alias("start"), "n", "bad", (F.col("bad") / F.col("n")).alias("share"))


def first_of_each(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, so that a resumed producer may send a record again."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
