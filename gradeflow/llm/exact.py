"""Exact deduplication by distributed MSD radix partitioning.

Texts are split into groups by their first digit, each group by the next digit, and so on; a digit is a
run of bytes, wider at each level, so that few levels reach the longest text. A group ends when it has one
member or when its texts have ended, and then its members are equal: no digest decides equality.

A group's number is the smallest row in it, which a partial aggregate finds before the shuffle, so a hot
group costs each task one row. Only rows of groups with several members go on to the next level. The groups of
a level are a written table, so that the join has a shuffle on both sides and adaptive execution can split the
members of a hot group over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table

#: Bytes of the first digit, and by how much each next one is wider.
FIRST, GROWTH = 64, 8
SPACES = "[ \\t-\\r]+"


def normalised(text: str = "text"):
    """UTF-8 bytes of the text with each run of blanks as one space; null counts as empty."""
    return F.encode(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACES, " "), "UTF-8")


def radix_groups(docs: DataFrame, row: str, scratch: Scratch, first: int = FIRST, growth: int = GROWTH) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a row number ``row`` as a written table, and the rows of groups of equal texts.

    The second table has (_row, _keep, _keep_id, _size) for every row whose text occurs more than once;
    ``_keep`` is the row with the smallest doc_id, nulls last, the smallest row number on a tie.
    """
    base = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "base")
    live = base.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id"), normalised().alias("_rest")).withColumn("_group", F.lit(0).cast("long"))
    done, width, level = [], first, 0
    while True:
        split = live.select("_row", "_id", "_group", F.substring("_rest", 1, width).alias("_digit"), F.expr(f"substring(_rest, {width + 1})").alias("_rest"))
        heads = split.groupBy("_group", "_digit").agg(F.count("*").alias("_size"), F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_head")).filter("_size > 1")
        heads = scratch.write(heads, f"heads{level}")
        members = split.join(heads.hint("merge"), ["_group", "_digit"]).select("_row", "_id", F.col("_head.row").alias("_group"), F.col("_head.id").alias("_keep_id"), "_size", F.when(F.length("_digit") < width, None).otherwise(F.col("_rest")).alias("_rest"))
        members = scratch.write(members, f"level{level}")
        scratch.drop(f"heads{level}")
        done.append(members.filter("_rest is null").select("_row", F.col("_group").alias("_keep"), "_keep_id", "_size"))
        live = members.filter("_rest is not null").select("_row", "_id", "_rest", "_group")
        width, level = width * growth, level + 1
        if live.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return base, out


def exact_groups(docs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and are equal to empty ones. Of equal texts the row with the smallest
    doc_id stays; a null doc_id comes after all others; of rows that share even the doc_id exactly one
    stays. A very long text takes more levels, of which each reads the rest of it. An empty table gives an
    empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    base, groups = radix_groups(docs.select("doc_id", "text"), "_row", scratch, first, growth)
    rows = base.select("_row", "doc_id", F.sha2(normalised(), 256).alias("text_sha256"))
    return rows.join(groups, "_row", "left").select(
        "doc_id",
        F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_keep") == F.col("_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay as they are, whatever their names."""
    scratch = Scratch(docs.sparkSession, "exact")
    row = fresh(docs, "_row")
    base, groups = radix_groups(docs, row, scratch)
    return base.join(groups.filter("_keep <> _row").select(F.col("_row").alias(row)), row, "left_anti").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
