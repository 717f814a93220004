"""Connected components by alternating large and small stars, every step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node of ``edges(u, v)``: the smallest node that it is connected with."""
    now, seen, i = scratch.write(edges.filter("u <> v").distinct(), f"{name}0"), None, 0
    while True:
        i += 1
        after = scratch.write(_small(_large(now)), f"{name}{i}")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}{i - 1}")
        now = after
        if mark == seen:
            break
        seen = mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
