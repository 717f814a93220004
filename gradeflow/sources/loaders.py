"""Raw records to canonical ones: (example_id, dataset, source_id, question, context, aliases, answerable), faults apart.

A loader returns all rows with ``fault``, null where the row is good; inputs stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def listed(text: Column) -> Column:
    """The parts of a list with semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def without_blank(aliases: Column) -> Column:
    """Aliases that hold something, trimmed, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def span_holds(context: Column, start: Column, answer: Column) -> Column:
    """Whether the answer stands in the context where it says, counted from 0."""
    return F.coalesce(F.substring(context, start + 1, F.length(answer)) == answer, F.lit(False)) & (F.length(answer) > 0)


def gold_number(text: Column) -> Column:
    """The number after the last ``####``, commas and an all-zero fraction removed; null if that is no number."""
    last = F.trim(F.element_at(F.split(F.coalesce(text, F.lit("")), "####"), -1))
    number = F.regexp_replace(last, ",", "")
    plain = F.regexp_replace(F.regexp_replace(number, r"^\+", ""), r"\.0+$", "")
    return F.when(F.contains(text, F.lit("####")) & number.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), plain)


def arithmetic(expression: Column) -> Column:
    """struct(a, op, b, value): the exact result of ``a op b``; value null for inexact divisions and unknown operators."""
    part = lambda i: F.regexp_extract(expression, r"^\s*(-?[0-9]+)\s*([-+*/x])\s*(-?[0-9]+)\s*$", i)
    a, op, b = part(1).try_cast("long"), part(2), part(3).try_cast("long")
    exact = F.when((b != 0) & (F.try_mod(a, b) == 0), F.expr("1"))
    value = F.when(op == "+", a + b).when(op == "-", a - b).when(op.isin("*", "x"), a * b).when((op == "/") & exact.isNotNull(), F.try_divide(a, b).cast("long"))
    return F.struct(a.alias("a"), op.alias("op"), b.alias("b"), value.alias("value"))


def source_id(dataset: str, question: Column) -> Column:
    """An id from the question itself: the same question has the same id."""
    return F.concat(F.lit(dataset + ":"), F.substring(F.sha2(T.normalised(question), 256), 1, 16))


def with_aliases(df: DataFrame, dataset: str, key: str, question: str, aliases: Column) -> DataFrame:
    """Questions with a list of answers; a blank question and a list without answers are faults."""
    x = df.select(F.concat(F.lit(dataset + ":"), F.col(key).cast("string")).alias("example_id"), F.lit(dataset).alias("dataset"), source_id(dataset, F.col(question)).alias("source_id"), F.trim(question).alias("question"), without_blank(aliases).alias("aliases"))
    return x.withColumn("fault", F.when(F.coalesce("question", F.lit("")) == "", "blank_question").when(F.size("aliases") == 0, "no_answers"))


def with_spans(df: DataFrame, key: str, question: str, context: str, start: str, answer: str) -> DataFrame:
    """Questions on a context; without an answer they are unanswerable, with one it must stand where it says."""
    x = df.select(F.concat(F.lit("squad:"), F.col(key).cast("string")).alias("example_id"), source_id("squad", F.col(question)).alias("source_id"), F.col(question).alias("question"), F.col(context).alias("context"), F.col(answer).alias("answer"), F.col(answer).isNotNull().alias("answerable"), F.col(start).alias("start"))
    fault = F.when(F.coalesce(F.trim("context"), F.lit("")) == "", "no_context").when(F.col("answerable") & ~span_holds(F.col("context"), F.col("start"), F.col("answer")), "span_not_in_context")
    return x.withColumn("fault", fault)


def with_gold(df: DataFrame, key: str, question: str, solution: str) -> DataFrame:
    """Questions whose solution ends with the answer after ``####``."""
    x = df.select(F.concat(F.lit("gsm8k:"), F.col(key).cast("string")).alias("example_id"), F.col(question).alias("question"), gold_number(F.col(solution)).alias("answer"))
    return x.withColumn("fault", F.when(F.col("answer").isNull(), "no_numeric_answer"))


def with_expressions(df: DataFrame, key: str, expression: str, stored: str) -> DataFrame:
    """Arithmetic questions; the stored answer must be the exact result."""
    x = df.select(F.concat(F.lit("arithmetic:"), F.col(key).cast("string")).alias("example_id"), arithmetic(F.col(expression)).alias("e"), F.col(stored).alias("stored"))
    fault = F.when(F.col("e.op") == "", "unsupported").when(F.col("e.value").isNull(), "inexact_division").when(~F.col("e.value").eqNullSafe(F.col("stored")), "wrong_stored_answer")
    return x.select("example_id", "e.a", "e.op", "e.b", "e.value", fault.alias("fault"))


def good(df: DataFrame) -> DataFrame:
    return df.filter("fault is null").drop("fault")


def quarantined(df: DataFrame) -> DataFrame:
    """(fault, n, first_id) of the rows that were left out."""
    return df.filter("fault is not null").groupBy("fault").agg(F.count("*").alias("n"), F.min("example_id").alias("first_id"))


def prepare_all(tables: dict[str, DataFrame], write=None) -> DataFrame:
    """(dataset, rows, good, faults) of every enabled dataset; with ``write(name, good rows)`` its good rows are written, else nothing is."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.count_if(F.col("fault").isNull()).alias("good"), F.count_if(F.col("fault").isNotNull()).alias("faults"))
        out = row if out is None else out.unionByName(row)
        if write:
            write(name, good(df))
    return out


def numbered_id(dataset: str, split: str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(dataset), F.lit(split), key.cast("string"))


#: What a record of ambiguous questions holds; other fields are passed over.
AMBIGUOUS = "id string, question string, annotations array<struct<type: string, answer: array<string>, qaPairs: array<struct<question: string, answer: array<string>>>>>"
SINGLE, SEVERAL = "singleAnswer", "multipleQAs"


def ambiguous(df: DataFrame, split: str) -> DataFrame:
    """Questions whose annotations are one answer or several interpretations, each with a question and answers of its own.

    (example_id, source_id, question, aliases, interpretations, is_ambiguous, n_interpretations, fault): interpretations
    stay grouped, in their order, over all annotations; all is one projection, no row is taken apart. A question with one
    answer has no interpretations and counts as one.
    """
    notes = F.coalesce("annotations", F.array().cast("array<struct<type: string, answer: array<string>, qaPairs: array<struct<question: string, answer: array<string>>>>>"))
    pairs = F.flatten(F.transform(F.filter(notes, lambda a: a["type"] == SEVERAL), lambda a: F.coalesce(a["qaPairs"], F.array().cast("array<struct<question: string, answer: array<string>>>"))))
    plain = F.flatten(F.transform(F.filter(notes, lambda a: a["type"] == SINGLE), lambda a: F.coalesce(a["answer"], F.array().cast("array<string>"))))
    x = df.select(
        numbered_id("ambignq", split, F.col("id")).alias("example_id"),
        F.col("id").cast("string").alias("source_id"),
        F.trim("question").alias("question"),
        notes.alias("_notes"),
        without_blank(plain).alias("_plain"),
        F.transform(pairs, lambda p, i: F.struct(i.cast("string").alias("name"), F.trim(p["question"]).alias("question"), without_blank(p["answer"]).alias("aliases"))).alias("interpretations"),
    )
    every = F.array_distinct(F.concat("_plain", F.flatten(F.transform("interpretations", lambda p: p["aliases"]))))
    several = F.size("interpretations") > 0
    fault = (
        F.when(F.coalesce("source_id", F.lit("")) == "", "no_id")
        .when(F.coalesce("question", F.lit("")) == "", "blank_question")
        .when(F.exists("_notes", lambda a: ~F.coalesce(a["type"], F.lit("")).isin(SINGLE, SEVERAL)), "unknown_annotation")
        .when(F.exists("interpretations", lambda p: F.size(p["aliases"]) == 0), "interpretation_without_answers")
        .when(F.size(every) == 0, "no_answers")
    )
    return x.select("example_id", "source_id", "question", every.alias("aliases"), "interpretations", several.alias("is_ambiguous"), F.greatest(F.lit(1), F.size("interpretations")).alias("n_interpretations"), fault.alias("fault"))


#: Columns of the file of truthfulness questions.
TRUTHFUL = ("Type", "Category", "Question", "Best Answer", "Best Incorrect Answer", "Correct Answers", "Incorrect Answers", "Source")


def read_truthful(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The CSV file; ``_corrupt`` has the lines with too few or too many fields, as they stand."""
    schema = ", ".join(f"`{c}` string" for c in TRUTHFUL) + ", _corrupt string"
    return spark.read.schema(schema).options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=True, escape='"', enforceSchema=False).csv(path)


def truthful(df: DataFrame) -> DataFrame:
    """(example_id, source_id, question, aliases, wrong_aliases, category, fault): answers that are right and answers that are wrong, apart.

    The id comes from the question, so it doesn't depend on the place in the file; the best answer stands first.
    """
    first = lambda best, rest: without_blank(F.concat(F.array(F.col(f"`{best}`")), listed(F.col(f"`{rest}`"))))
    own = F.substring(F.sha2(T.normalised(F.col("Question")), 256), 1, 16)
    x = df.select(numbered_id("truthfulqa", "validation", own).alias("example_id"), own.alias("source_id"), F.trim("Question").alias("question"), first("Best Answer", "Correct Answers").alias("aliases"), first("Best Incorrect Answer", "Incorrect Answers").alias("wrong_aliases"), F.col("Category").alias("category"), "_corrupt")
    fault = F.when(F.col("_corrupt").isNotNull(), "malformed_line").when(F.coalesce("question", F.lit("")) == "", "blank_question").when(F.size("aliases") == 0, "no_answers").when(F.size("wrong_aliases") == 0, "no_wrong_answers")
    return x.withColumn("fault", fault).drop("_corrupt")


#: What a record of questions with evidence holds; other fields are passed over.
EVIDENCE = "QuestionId string, Question string, Answer struct<Value: string, Aliases: array<string>, NormalizedAliases: array<string>>, EntityPages array<struct<Filename: string, Title: string, DocSource: string>>, SearchResults array<struct<Filename: string, Title: string, Url: string>>"


def with_evidence(df: DataFrame, split: str, variant: str = "wikipedia") -> DataFrame:
    """(example_id, source_id, question, aliases, normalised_aliases, evidence, fault): ``evidence`` refers to files, which aren't examples themselves.

    Aliases begin with the answer's value; of the web variant evidence is the search results, else the entity pages.
    A record without an answer is a fault.
    """
    pages = F.col("EntityPages") if variant == "wikipedia" else F.col("SearchResults")
    files = F.filter(F.coalesce(F.transform(pages, lambda p: F.struct(F.concat(F.lit(f"evidence/{variant}/"), p["Filename"]).alias("path"), p["Title"].alias("title"))), F.array()), lambda e: e["path"].isNotNull())
    aliases = without_blank(F.concat(F.array("Answer.Value"), F.coalesce("Answer.Aliases", F.array().cast("array<string>"))))
    x = df.select(numbered_id("triviaqa", split, F.col("QuestionId")).alias("example_id"), F.col("QuestionId").alias("source_id"), F.trim("Question").alias("question"), aliases.alias("aliases"), F.coalesce("Answer.NormalizedAliases", F.array().cast("array<string>")).alias("normalised_aliases"), files.alias("evidence"), F.col("Answer").isNull().alias("_none"))
    fault = F.when(F.coalesce("source_id", F.lit("")) == "", "no_id").when(F.coalesce("question", F.lit("")) == "", "blank_question").when(F.col("_none") | (F.size("aliases") == 0), "answerless")
    return x.withColumn("fault", fault).drop("_none")
