"""Logical files in a stated order: parts sorted by range, a hash tree over their lines, versions behind a pointer.

A version is a folder of text files whose names are in the order of their lines, so that they are one file if put
together by name. Its digest is the root of a tree: lines are numbered, each ``WIDTH`` of them are a leaf, each
``WIDTH`` nodes have a parent, and a node's digest is the SHA-256 of what is below it, or that itself if it is one node. The tree depends on the lines
alone, not on how they are cut into files, and a file of at most ``WIDTH`` lines has the plain digest of its bytes.
A pointer names a version and is published by one rename to a name that isn't there: readers take the last pointer,
so a crash between the steps leaves the version before in place.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import number_of_ranges, running
from .shared import file_system, kept

#: Lines of a leaf and nodes of a parent.
WIDTH = 1024


def tree_digests(df: DataFrame, by: list[str], order: list[str], line: str, width: int = WIDTH, levels: int | None = None) -> DataFrame:
    """(by, digest, lines): of each group the root of the hash tree over its lines (with a line break each) in ``order``.

    Each task holds single nodes: at most ``width`` lines or digests. ``order`` must tell a group's lines apart. With
    ``levels`` a tree has no more of them above its leaves: a group of more lines has several trees, a row each.
    """
    if not by:
        return tree_digests(df.withColumn("_whole", F.lit(0)), ["_whole"], order, line, width, levels).drop("_whole")
    rows = kept(running(df.select(*dict.fromkeys([*by, *order]), F.concat(F.col(line), F.lit("\n")).alias("_line")), by, order, {"_n": F.lit(1).cast("long")}))
    at = F.col("_n") - 1
    leaves = rows.groupBy(*by, F.floor(at / width).alias("_i")).agg(F.array_sort(F.collect_list(F.struct(at.alias("n"), F.col("_line").alias("x")))).alias("_below"), F.count("*").alias("_lines"))
    nodes = leaves.select(*by, "_i", F.sha2(F.array_join("_below.x", ""), 256).alias("_digest"), "_lines")
    most = nodes.agg(F.max("_i")).first()[0] or 0
    level = 0
    while most > 0 and (levels is None or level < levels):  # a level for each power of the width
        level += 1
        above = kept(nodes).groupBy(*by, F.floor(F.col("_i") / width).alias("_i")).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("n"), F.col("_digest").alias("x")))).alias("_below"), F.sum("_lines").alias("_lines"))
        joined = F.when(F.size("_below") > 1, F.sha2(F.array_join("_below.x", ""), 256)).otherwise(F.col("_below")[0]["x"])
        nodes = above.select(*by, "_i", joined.alias("_digest"), "_lines")
        most //= width
    return nodes.select(*by, F.col("_digest").alias("digest"), F.col("_lines").alias("lines"))


class Versions:
    """Versions of one logical file of lines in a folder: ``v-*`` with the lines, ``pointer-*`` with which one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, pattern: str) -> list[str]:
        fs, target = file_system(self.spark, self.folder)
        names = [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []
        return sorted(n for n in names if re.fullmatch(pattern, n))

    def current(self) -> dict | None:
        """What the last pointer says: version, digest, lines and number; None before the first."""
        names = self._names(r"pointer-\d{9}")
        if not names:
            return None
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.folder}/{names[-1]}").first()["value"]) | {"number": int(names[-1][8:])}

    def write(self, lines: DataFrame, order: list[str], line: str = "value") -> dict:
        """The lines in ``order`` as a new version that nothing points to yet."""
        name = f"v-{uuid.uuid4().hex}"
        parts = number_of_ranges(lines)
        lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.col(line).alias("value")).write.text(f"{self.folder}/{name}")
        root = tree_digests(lines, [], order, line).first()
        return {"version": name, "digest": root["digest"] if root else text_digest(""), "lines": root["lines"] if root else 0}

    def publish(self, version: dict, after: int | None = None) -> dict:
        """Make a written version the one that counts, if the last pointer still is number ``after`` (whichever it is, by default)."""
        now = self.current()
        number = now["number"] if now else 0
        if after is not None and number != after:
            raise ValueError(f"{self.folder} is at {number}, not at {after}")
        new = f"{self.folder}/.next-{uuid.uuid4().hex}"
        fs, source = file_system(self.spark, new)
        out = fs.create(source)
        out.write(bytearray(json.dumps(version, sort_keys=True).encode()))
        out.close()
        _, target = file_system(self.spark, f"{self.folder}/pointer-{number + 1:09d}")
        if fs.exists(target) or not fs.rename(source, target):
            raise ValueError(f"another writer has published {number + 1} in {self.folder}")
        return version | {"number": number + 1}

    def replace(self, lines: DataFrame, order: list[str], line: str = "value", after: int | None = None) -> dict:
        return self.publish(self.write(lines, order, line), after)

    def read(self) -> DataFrame:
        """(part, value): the lines of the version that counts; files by name and lines within them are in its order."""
        now = self.current()
        if now is None:
            raise FileNotFoundError(self.folder)
        return self.spark.read.text(f"{self.folder}/{now['version']}").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part"), "value")

    def tidy(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` pointers and the versions that none of them names; the names of what went."""
        pointers = self._names(r"pointer-\d{9}")
        named = {json.loads(self.spark.read.option("wholetext", True).text(f"{self.folder}/{p}").first()["value"])["version"] for p in pointers[-keep:]}
        gone = [*pointers[:-keep], *(v for v in self._names(r"v-[0-9a-f]{32}") if v not in named)]
        for name in gone:
            fs, target = file_system(self.spark, f"{self.folder}/{name}")
            fs.delete(target, True)
        return gone


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
