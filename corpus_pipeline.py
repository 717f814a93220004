"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All but the last return the columns of documents, whatever further ones there are.
Every stage takes null ids and repeated rows as rows of their own, reads very long texts whole, and gives an empty
table for an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm import decontaminate, exact, jaccard, langid, pieces
from gradeflow.llm.common import Scratch, fold, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; null texts and texts without a letter go."""
    learn = docs.select("doc_id", "text", "lang").filter(fold("doc_id", 4) != 2)
    return langid.predict(docs, langid.fit(learn)).filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: that of the smallest doc_id, nulls last; of rows that share even that, one. Null texts equal empty ones."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest doc_id."""
    return jaccard.drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark; null and empty texts hold none and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and whether they decode to it; a null text has none."""
    return pieces.encode(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark_leaks", leaks), ("tokens", tokens)]

#: A learned classifier and a byte-pair encoder aren't SQL: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents`` of a folder; what each stage kept is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")

    def apply(docs: DataFrame, stage) -> DataFrame:
        name, function = stage
        return scratch.write(function(spark, docs, sf_dir), name)

    return functools.reduce(apply, STAGES, table(spark, sf_dir, "documents"))
