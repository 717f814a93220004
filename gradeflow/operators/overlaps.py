"""Records that share a source or a question, within and across splits: by keys, without pairs.

Records are linked through keys, so a key that very many records have costs each of them one row. Each kind of overlap
names for every record but the first of a key that first one; connected groups over all keys have their members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept

#: The kinds of overlap.
SOURCE, QUESTION, SPLIT = "shared_source_id", "normalized_question_overlap", "cross_split_overlap"


def keyed(records: DataFrame) -> DataFrame:
    """(reason, key, example_id, split) of ``records(example_id, split, source_id, question)``; blank sources and questions are no keys.

    An example_id that stands twice is an error.
    """
    rows = records.select("example_id", "split", F.array(F.struct(F.lit(SOURCE).alias("reason"), F.col("source_id").cast("string").alias("key")), F.struct(F.lit(QUESTION).alias("reason"), T.normalised(F.col("question")).alias("key"))).alias("k"))
    twice = rows.groupBy("example_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"Duplicate example ID: {twice[0]['example_id']}")
    return rows.select(F.explode("k").alias("k"), "example_id", "split").select("k.reason", "k.key", "example_id", "split").filter("key <> ''")


def overlaps(records: DataFrame) -> DataFrame:
    """(reason, excluded_id, matched_id): of each key every record but the first by id, with that first one; and every record with the first of its key in another split.

    Both ids stay. A key's records are never paired with each other: two records of another split are matched with the
    same first one.
    """
    rows = keyed(records)
    heads = rows.groupBy("reason", "key").agg(F.count("*").alias("n"), F.min(F.struct("example_id", "split")).alias("first")).filter("n > 1")
    apart = kept(rows.groupBy("reason", "key", "split").agg(F.min("example_id").alias("id")))
    others = apart.groupBy("reason", "key").agg(F.array_sort(F.collect_list(F.struct("id", "split"))).alias("by_split"))  # a row a split
    both = kept(heads.join(others, ["reason", "key"]))
    found = rows.join(both.hint("merge"), ["reason", "key"])
    same = found.filter("example_id <> first.example_id").select("reason", F.col("example_id").alias("excluded_id"), F.col("first.example_id").alias("matched_id"))
    other = F.get(F.filter("by_split", lambda s: s["split"] != F.col("split")), F.lit(0))["id"]
    across = found.withColumn("matched_id", other).filter("matched_id is not null and example_id > matched_id").groupBy(F.lit(SPLIT).alias("reason"), F.col("example_id").alias("excluded_id")).agg(F.min("matched_id").alias("matched_id"))
    return same.unionByName(across)


def _roots(parents: DataFrame) -> DataFrame:
    """``parents(group, parent)`` with each group's last ancestor, by doubling the steps until none moves."""
    while True:
        ahead = parents.select(F.col("group").alias("parent"), F.col("parent").alias("further"))
        new = kept(parents.join(ahead.hint("merge"), "parent", "left").select("group", F.coalesce("further", "parent").alias("parent"), (F.col("further") != F.col("parent")).alias("moved")))
        parents = new.select("group", "parent")
        if new.filter("moved").isEmpty():
            return parents


def groups(records: DataFrame) -> DataFrame:
    """(example_id, split, group, size, splits): which records hang together through any keys; the group is its smallest id.

    Each round every group joins the smallest one that any of its keys leads to, so that a group stays by itself only
    if all around it join it; rounds and steps within a round grow with the logarithm of the number of records.
    """
    links = kept(keyed(records).select(F.concat_ws(":", "reason", "key").alias("key"), "example_id"))
    now = kept(records.select("example_id", F.col("example_id").alias("group")))
    while True:
        placed = kept(links.join(now.hint("merge"), "example_id").select("key", "group").distinct())
        least = kept(placed.groupBy("key").agg(F.min("group").alias("least")))
        parents = kept(placed.join(least.hint("merge"), "key").groupBy("group").agg(F.min("least").alias("parent")))
        if parents.filter("group <> parent").isEmpty():
            break
        roots = _roots(parents)
        now = kept(now.join(roots.hint("merge"), "group", "left").select("example_id", F.coalesce("parent", "group").alias("group")))
    sizes = kept(now.join(records.select("example_id", "split"), "example_id").groupBy("group").agg(F.count("*").alias("size"), F.countDistinct("split").alias("splits")))
    return records.select("example_id", "split").join(now, "example_id").join(sizes.hint("merge"), "group").select("example_id", "split", "group", "size", "splits")
