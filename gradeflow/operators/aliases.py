"""Answers against very many aliases: by equality and by indexes of grams and words, not by a list that each answer goes through.

Aliases are a table (question, alias), answers another (question, id, response). Both are joined on the question and
on something rare that they share; what is found is then verified, so results are exact. No side is broadcast unless
Spark knows it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import kept

#: Characters of a gram; aliases that are shorter are sought whole among grams of their own length.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def prepared(answers: DataFrame, aliases: DataFrame, question: str, key: str, response: str, alias: str) -> tuple[DataFrame, DataFrame]:
    """(question, id, r) and (question, given, a): normalised, each alias of a question once with the first form it was given in."""
    a = answers.select(F.col(question).alias("question"), F.col(key).alias("id"), T.normalised(F.col(response)).alias("r"))
    b = aliases.select(F.col(question).alias("question"), F.col(alias).alias("given"), T.normalised(F.col(alias)).alias("a"))
    return kept(a), kept(b.groupBy("question", "a").agg(F.min("given").alias("given")))


def exact_matches(answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question, id, given): the alias that an answer equals, of tables as ``prepared`` makes them."""
    return answers.join(aliases, (answers["question"] == aliases["question"]) & (answers["r"] == aliases["a"])).select(answers["question"], "id", "given")


def contained(answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question, id, given, a): every alias that stands in an answer, by characters.

    An alias is indexed under one gram, the one that the fewest aliases have; an answer asks for all its grams. A gram
    of the answer that no alias is indexed under is dropped before the join, and what the join finds is checked in full.
    Equal answers to a question are sought once.
    """
    whole = aliases.filter("a <> ''")
    grams = whole.select("question", "a", "given", F.explode(F.when(F.length("a") >= GRAM, _grams(F.col("a"), GRAM)).otherwise(F.array("a"))).alias("gram"))
    counts = kept(grams.groupBy("gram").agg(F.count("*").alias("n")))
    rarest = grams.join(counts.hint("merge"), "gram").groupBy("question", "a", "given").agg(F.min(F.struct("n", "gram")).alias("g"))
    index = kept(rarest.select("question", "a", "given", F.col("g.gram").alias("gram")))
    asked = answers.select("question", "r").distinct().select("question", "r", F.explode(F.concat(*(_grams(F.col("r"), n) for n in range(1, GRAM + 1)))).alias("gram"))
    asked = asked.join(kept(index.select("question", "gram").distinct()).hint("merge"), ["question", "gram"], "left_semi")
    found = kept(asked.join(index.hint("merge"), ["question", "gram"]).filter(F.contains("r", F.col("a"))).select("question", "r", "given", "a"))
    return answers.join(found, ["question", "r"]).select("question", "id", "given", "a")


def best_overlap(answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question, id, best_f1): the best word F1 of each answer with any alias of its question, 0 where none shares a word.

    Words are joined by their occurrence (a word's second one is a key of its own), so that joined rows are the size of
    the common multiset; answers and aliases with no word in common never meet. Equal answers to a question are compared once.
    """
    one = answers.select("question", F.col("r").alias("id")).distinct().select("question", "id", F.filter(F.split("id", " "), lambda w: w != "").alias("w"))
    two = aliases.select("question", "a", F.filter(F.split("a", " "), lambda w: w != "").alias("w"))

    def occurrences(df: DataFrame, *names: str) -> DataFrame:
        counted = df.select(*names, F.size("w").alias("n"), F.explode_outer("w").alias("word")).groupBy(*names, "n", "word").agg(F.count("*").alias("k"))
        return counted.filter("word is not null").select(*names, "n", "word", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("nth"))

    left = occurrences(one, "question", "id")
    right = kept(occurrences(two, "question", "a").withColumnRenamed("n", "m"))
    common = left.join(right.hint("merge"), ["question", "word", "nth"]).groupBy("question", "id", "a", "n", "m").agg(F.count("*").alias("c"))
    best = common.groupBy("question", "id").agg(F.max(2.0 * F.col("c") / (F.col("n") + F.col("m"))).alias("f1"))
    empty = two.filter(F.size("w") == 0).select("question").distinct().withColumn("none", F.lit(1.0))
    out = one.select("question", "id", (F.size("w") == 0).alias("blank")).join(best, ["question", "id"], "left").join(empty, "question", "left")
    of_texts = kept(out.select("question", F.col("id").alias("r"), F.when(F.col("blank"), F.coalesce("none", F.lit(0.0))).otherwise(F.coalesce("f1", F.lit(0.0))).alias("best_f1")))
    return answers.select("question", "id", "r").join(of_texts, ["question", "r"], "left").select("question", "id", F.coalesce("best_f1", F.lit(0.0)).alias("best_f1"))
