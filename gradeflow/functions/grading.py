"""Grading of responses against references: aliases, interpretations, spans, numbers and truthfulness.

Functions of columns judge one row; functions of tables explode a response's segments and interpretations
and group them by ``id`` again. Normalised arrays are columns of their own, so that no expression is planned twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Most additional words of a concise answer, the dead band of lexical leaning, overlap that needs a look.
MOST_EXTRA, DEAD_BAND, HIGH_OVERLAP, LOW_OVERLAP = 8, 0.05, 0.5, 0.2


def prepared(df: DataFrame, response: str, **aliases: str) -> DataFrame:
    """``df`` with the normalised forms that the functions below read.

    ``_r`` and ``_rw`` are the response as text and words, ``_rp`` without brackets; for ``name=column`` of an
    array of aliases, ``_name``, ``_name_w`` and ``_name_p`` are the same of each alias.
    """
    out = df.withColumns({"_rw": T.words(F.col(response)), "_rp": T.normalised(T.without_parentheses(F.coalesce(response, F.lit(""))))}).withColumn("_r", F.concat_ws(" ", "_rw"))
    return with_aliases(out, **aliases)


def with_aliases(out: DataFrame, **aliases: str) -> DataFrame:
    """The part of ``prepared`` for arrays of aliases."""
    for name, column in aliases.items():
        out = out.withColumn(f"_{name}_w", F.transform(F.col(column), T.words))
        out = out.withColumns({f"_{name}": F.transform(f"_{name}_w", lambda w: F.concat_ws(" ", w)), f"_{name}_p": F.transform(F.col(column), lambda a: T.normalised(T.without_parentheses(a)))})
    return out


def _needs_aliases(name: str, value: Column) -> Column:
    """An empty list of aliases is an error, not a wrong answer."""
    return F.when(F.size(f"_{name}") > 0, value).otherwise(F.raise_error(F.lit("no aliases")).cast("double"))


def exact(name: str) -> Column:
    return F.array_contains(f"_{name}", F.col("_r"))


def best_f1(name: str) -> Column:
    return _needs_aliases(name, F.array_max(F.transform(f"_{name}_w", lambda w: T.token_f1(F.col("_rw"), w))))


def matched(name: str) -> Column:
    """Places of the aliases that equal the response."""
    return F.filter(F.transform(f"_{name}", lambda a, i: F.when(a == F.col("_r"), i)), lambda i: i.isNotNull())


def containment(name: str, column: str) -> Column:
    """struct of the seven diagnostics: by characters, both ways, and the alias of the best F1 (the first on ties).

    Aliases are compared as normalised in ``name`` and given as they stand in ``column``.
    """
    r = F.col("_r")
    scores = F.transform(f"_{name}_w", lambda w: T.token_f1(F.col("_rw"), w))
    pairs = F.arrays_zip(F.col(f"_{name}").alias("n"), F.col(column).alias("given"))
    fitting = lambda ok: F.transform(F.filter(pairs, lambda p: ok(p["n"])), lambda p: p["given"])
    inside, around = fitting(lambda a: (a != "") & F.contains(r, a)), fitting(lambda a: (r != "") & F.contains(a, r))
    return F.struct(
        exact(name).alias("exact"),
        (F.size(inside) > 0).alias("alias_in_response"),
        (F.size(around) > 0).alias("response_in_alias"),
        inside.alias("contained_aliases"),
        around.alias("containing_aliases"),
        F.array_max(scores).alias("best_f1"),
        F.get(F.col(column), F.array_position(scores, F.array_max(scores)).cast("int") - 1).alias("best_alias"),
    )


def concise(name: str) -> Column:
    """The first rule by which any alias accepts the response: exact, without brackets on either side, or as its end."""
    r, aliases = F.col("_r"), F.col(f"_{name}")
    ends = F.filter(f"_{name}_w", lambda w: (F.size(w) > 0) & F.endswith(r, F.concat_ws(" ", w)))
    extra = F.array_min(F.transform(ends, lambda w: F.size("_rw") - F.size(w)))
    return (
        F.when(F.array_contains(aliases, r), "normalized_exact")
        .when(F.array_contains(aliases, F.col("_rp")), "response_parenthetical")
        .when(F.array_contains(f"_{name}_p", r), "alias_parenthetical")
        .when(extra <= MOST_EXTRA, "concise_containment")
    )


def truth_status(right: str, wrong: str) -> Column:
    a, b = exact(right), exact(wrong)
    return F.when(a & b, "matched_both_reference_sets").when(a, "matched_correct_reference").when(b, "matched_incorrect_reference").otherwise("unmatched")


def leaning(response: str, right: str, wrong: str) -> Column:
    """Which reference set a response is closer to by words; a refusal first, then a dead band."""
    gap = best_f1(right) - best_f1(wrong)
    return F.when(T.refusal(F.col(response)), "refusal_or_uncertainty").otherwise(_side(gap))


def _side(gap: Column) -> Column:
    return F.when(F.abs(gap) < DEAD_BAND, "neither").when(gap > 0, "correct_reference_leaning").otherwise("incorrect_reference_leaning")


def audited_leaning(right: str, wrong: str) -> Column:
    """As ``leaning``, but exact matches decide first and refusals don't count."""
    a, b = exact(right), exact(wrong)
    return F.when(a & b, "both").when(a, "correct_reference_leaning").when(b, "incorrect_reference_leaning").otherwise(_side(best_f1(right) - best_f1(wrong)))


def span_scores(name: str, answerable: str) -> Column:
    """struct(correct, f1, no_answer): an unanswerable question is right if the response is empty or abstains by its one word."""
    abstained = F.col("_r").isin("", T.UNANSWERABLE)
    ok = F.col(answerable)
    return F.struct(F.when(ok, exact(name)).otherwise(abstained).alias("correct"), F.when(ok, best_f1(name)).otherwise(abstained.cast("double")).alias("f1"), F.when(~ok, abstained.cast("double")).alias("no_answer"))


#: Kinds of responses to a question with aliases, from the strictest match down.
ALIAS_CATEGORIES = ("exact_alias_match", "normalized_alias_match", "alias_in_concise_response", "alias_contained_diagnostic_only", "response_contained_in_alias", "token_overlap_match", "clearly_incorrect", "unclear")


def alias_category(name: str, column: str, stored: Column) -> Column:
    """The first of the eight kinds that fits; ``stored`` is the match that was recorded when the response was graded."""
    bundle = containment(name, column)
    tests = (stored, bundle["exact"], concise(name).isNotNull(), bundle["alias_in_response"], bundle["response_in_alias"], bundle["best_f1"] >= HIGH_OVERLAP, bundle["best_f1"] < LOW_OVERLAP)
    out = F.when(tests[0], ALIAS_CATEGORIES[0])
    for test, kind in zip(tests[1:], ALIAS_CATEGORIES[1:], strict=False):
        out = out.when(test, kind)
    return out.otherwise(ALIAS_CATEGORIES[-1])


#: interpretations: array<struct<name: string, aliases: array<string>>>
def single_interpretation(interpretations: str, aliases: str) -> Column:
    """A question without interpretations has one, of its own aliases."""
    one = F.array(F.struct(F.lit("single_answer").alias("name"), F.col(aliases).alias("aliases")))
    return F.when(F.size(F.coalesce(F.col(interpretations), F.array())) > 0, F.col(interpretations)).otherwise(one)


def recall(df: DataFrame, key: str = "id", response: str = "response", interpretations: str = "interpretations") -> DataFrame:
    """(key, interpretations, matched, any_match, recall, mean_f1): exact matches of the whole response with each interpretation.

    A response without interpretations matches none of none: its recall and mean F1 are null.
    """
    each = df.select(key, response, F.explode_outer(interpretations).alias("x")).withColumn("aliases", F.coalesce("x.aliases", F.array()))
    there = F.col("x").isNotNull()
    scored = prepared(each, response, a="aliases").select(key, there.alias("there"), (there & exact("a")).alias("m"), F.when(there, best_f1("a")).alias("f1"))
    hit, n = F.count_if("m"), F.count_if("there")
    return scored.groupBy(key).agg(n.alias("interpretations"), hit.alias("matched"), (hit > 0).alias("any_match"), F.when(n > 0, hit / n).alias("recall"), F.avg("f1").alias("mean_f1"))


def coverage(df: DataFrame, key: str = "id", response: str = "response", interpretations: str = "interpretations") -> DataFrame:
    """Which interpretations the segments of a response cover.

    Numbered lines answer the interpretation of their number only; else any segment may answer any, or the
    whole response does. One row a response: (key, interpretations, covered, coverage, any_match, several, best_f1,
    segments, matched_segments). Matched segments are counted by their place among an interpretation's own candidates.
    A response without interpretations covers none: its coverage is null and its best F1 0.
    """
    lines = df.select(key, F.col(response).alias("whole"), F.col(interpretations).alias("xs"), T.numbered(F.coalesce(F.col(response), F.lit(""))).alias("lines"))
    cut = lines.withColumn("parts", F.when(F.size("lines") > 0, F.transform("lines", lambda x: x["text"])).otherwise(T.segments(F.coalesce(F.col("whole"), F.lit("")))))
    each = cut.select(key, "whole", "lines", "parts", F.posexplode_outer("xs").alias("k", "x"))
    own = F.when(F.size("lines") > 0, F.transform(F.filter("lines", lambda x: x["place"] == F.col("k")), lambda x: x["text"])).otherwise(F.col("parts"))
    # the whole response stands at -1; of numbered ones it counts for F1 alone
    candidates = F.concat(F.array(F.struct(F.lit(-1).alias("place"), F.col("whole").alias("part"))), F.transform(own, lambda t, i: F.struct(i.alias("place"), t.alias("part"))))
    each = with_aliases(each.select(key, "k", "lines", F.coalesce("x.aliases", F.array()).alias("aliases"), F.size("parts").alias("segments"), candidates.alias("cs")), a="aliases")
    of_aliases = ["_a", "_a_w", "_a_p"]  # once an interpretation, not once a candidate
    rows = each.select(key, "k", *of_aliases, "segments", (F.size("lines") > 0).alias("by_number"), F.explode("cs").alias("c"))
    rows = rows.select(key, "k", *of_aliases, "segments", "by_number", "c.place", "c.part")
    there = F.col("k").isNotNull()
    match = there & concise("a").isNotNull() & ((F.col("place") >= 0) | ~F.col("by_number"))
    judged = prepared(rows, "part").select(key, "k", "segments", "place", match.alias("m"), F.when(there, best_f1("a")).otherwise(0.0).alias("f1"))
    by_k = judged.groupBy(key, "k").agg(F.bool_or("m").alias("m"), F.max("f1").alias("f1"), F.max("segments").alias("segments"), F.collect_set(F.when(F.col("m") & (F.col("place") >= 0), F.col("place"))).alias("at"))
    covered, n = F.count_if("m"), F.count("k")
    return by_k.groupBy(key).agg(n.alias("interpretations"), covered.alias("covered"), F.when(n > 0, covered / n).alias("coverage"), (covered > 0).alias("any_match"), (covered > 1).alias("several"), F.max("f1").alias("best_f1"), F.max("segments").alias("segments"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("matched_segments"))


def shared_aliases(df: DataFrame, key: str = "id", response: str = "response", interpretations: str = "interpretations") -> DataFrame:
    """(key, shared): the number of aliases that several interpretations own and that stand in the response; only where there are some."""
    owners = df.select(key, T.normalised(F.col(response)).alias("r"), F.explode(interpretations).alias("x")).select(key, "r", "x.name", F.explode("x.aliases").alias("alias")).select(key, "r", "name", T.normalised(F.col("alias")).alias("alias"))
    by_alias = owners.filter("alias <> ''").groupBy(key, "r", "alias").agg(F.countDistinct("name").alias("k")).filter("k > 1 and contains(r, alias)")
    return by_alias.groupBy(key).agg(F.count("*").alias("shared"))


def interpretation_labels(df: DataFrame, key: str = "id", response: str = "response", interpretations: str = "interpretations") -> DataFrame:
    """``coverage`` with precision and labels; unresolved where a shared alias stands in the response."""
    c = coverage(df, key, response, interpretations).join(shared_aliases(df, key, response, interpretations), key, "left")
    precision = F.when(F.col("segments") > 0, F.least(F.lit(1.0), F.col("matched_segments") / F.col("segments"))).otherwise(0.0)
    c = c.withColumns({"precision": precision, "unresolved": F.col("shared").isNotNull()})
    c = c.withColumn("provisional", F.when(F.col("covered") == 0, "incorrect").when((F.col("covered") == F.col("interpretations")) & (F.col("precision") == 1.0), "fully_correct").otherwise("partially_correct"))
    label = F.when(~F.col("unresolved"), F.col("provisional"))
    ordinal = F.when(label == "incorrect", 0).when(label == "partially_correct", 1).when(label == "fully_correct", 2)
    return c.withColumns({"label": label, "ordinal": ordinal, "fully_wrong": (ordinal == 0).cast("int"), "incomplete": (ordinal < 2).cast("int"), "unsupported": F.greatest(F.lit(0), F.col("segments") - F.col("matched_segments"))}).drop("shared")


def graded(df: DataFrame) -> DataFrame:
    """One row a record of ``df(id, dataset, response, aliases, wrong_aliases, answerable, interpretations)``.

    (id, dataset, correct, error, unresolved): arithmetic by the only or the final number, aliases exactly, ambiguous
    questions by any interpretation, spans by abstention where unanswerable, truthfulness never by itself.
    """
    ambiguous = df.filter("dataset = 'ambignq'").withColumn("interpretations", single_interpretation("interpretations", "aliases"))
    rest = prepared(df.filter("dataset <> 'ambignq'"), "response", a="aliases")
    first = F.get("aliases", F.lit(0))
    verdict = (
        F.when(F.col("dataset") == "arithmetic", T.arithmetic_match(F.col("response"), first))
        .when(F.col("dataset") == "gsm8k", T.arithmetic_match(F.col("response"), first, final=True))
        .when(F.col("dataset") == "triviaqa", exact("a"))
        .when((F.col("dataset") == "squad") & F.col("answerable"), exact("a"))
        .when(F.col("dataset") == "squad", T.abstention(F.col("response")).isNotNull())
        .when(F.col("dataset") == "truthfulqa", F.lit(None).cast("boolean"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown dataset "), "dataset")).cast("boolean"))
    )
    both = rest.select("id", "dataset", verdict.alias("correct")).unionByName(ambiguous.select("id", "dataset").join(recall(ambiguous).select("id", F.col("any_match").alias("correct")), "id"))
    return both.select("id", "dataset", "correct", (~F.col("correct")).cast("int").alias("error"), F.col("correct").isNull().alias("unresolved"))


def revised(df: DataFrame) -> DataFrame:
    """(id, dataset, status, correct): a second look at each record by the wider rules, with the reason as a status.

    A record that no wider rule is for is unchanged: it keeps the correctness of ``graded``. Truthfulness stays open.
    """
    ambiguous = df.filter("dataset = 'ambignq'").withColumn("interpretations", single_interpretation("interpretations", "aliases"))
    c = coverage(ambiguous)
    by_segments = c.select("id", F.lit("ambignq").alias("dataset"), F.when(F.col("several"), "multiple_interpretations").when(F.col("any_match"), "one_interpretation").when(F.col("best_f1") >= HIGH_OVERLAP, "high_overlap_unresolved").otherwise("clearly_incorrect").alias("status"), F.col("any_match").alias("correct"))
    rest = prepared(df.filter("dataset <> 'ambignq'"), "response", a="aliases", b="wrong_aliases")
    rule, abstained = concise("a"), T.abstention(F.col("response"))
    open_question = (F.col("dataset") == "squad") & ~F.col("answerable")
    status = (
        F.when(F.col("dataset") == "triviaqa", F.coalesce(rule, F.when(best_f1("a") > 0, "token_overlap").otherwise("clearly_incorrect")))
        .when(open_question, F.coalesce(abstained, F.lit("unsupported_answer")))
        .when(F.col("dataset") == "truthfulqa", audited_leaning("a", "b"))
        .otherwise("unchanged")
    )
    correct = F.when(F.col("dataset") == "triviaqa", rule.isNotNull()).when(open_question, abstained.isNotNull())
    looked = rest.select("id", "dataset", status.alias("status"), correct.alias("_new"))
    first = graded(df.filter("dataset <> 'ambignq'")).select("id", F.col("correct").alias("_old"))
    kept = F.when(F.col("status") == "unchanged", F.col("_old")).otherwise(F.col("_new"))
    return looked.join(first, "id").select("id", "dataset", "status", kept.alias("correct")).unionByName(by_segments)


def response_diagnostics(df: DataFrame, key: str = "id", response: str = "response") -> DataFrame:
    """How a response ended, where it states its answer, what follows, and how much of it repeats.

    ``df`` has the collection's own fields too: stop_reason, token_limit_reached, parsing_status, stop_detected,
    token_ids and correct.
    """
    own = ("stop_reason", "token_limit_reached", "parsing_status", "stop_detected", "token_ids", "correct")
    w = df.select(key, *own, F.col(response).alias("t"), T.tokens(F.col(response)).alias("w"), T.sentences(F.col(response)).alias("s"), T.last_answer(F.col(response)).alias("a"))
    w = w.withColumn("g", T.ngrams(F.col("w"), 4))
    rates = w.withColumns({"ngram_rate": T.repetition(F.col("g")), "sentence_rate": T.repetition(F.col("s"))})
    right, goes_on = F.coalesce("correct", F.lit(False)), F.regexp_replace(F.coalesce("a.trailing", F.lit("")), r"\s+", "") != ""
    return rates.select(
        key,
        (F.col("stop_reason") == "eos_token").alias("eos_reached"),
        F.col("token_limit_reached").alias("truncated"),
        (F.col("parsing_status") != "ok").alias("parse_failure"),
        F.col("a.place").isNotNull().alias("answer_marker_present"),
        F.col("a.place").alias("answer_marker_character_position"),
        F.col("a.relative").alias("answer_marker_relative_position"),
        F.coalesce("stop_detected", F.lit(False)).alias("final_answer_stop_detected"),
        F.size("token_ids").alias("generated_token_count"),
        F.length("t").alias("response_character_count"),
        T.repetition(F.col("token_ids")).alias("repetition_rate"),
        F.col("ngram_rate").alias("repeated_ngram_rate"),
        F.col("sentence_rate").alias("repeated_sentence_rate"),
        T.loops(F.col("ngram_rate"), F.col("sentence_rate")).alias("repetitive_loop"),
        right.alias("exact_answer_correct"),
        (right & goes_on).alias("correct_final_answer_before_continued_generation"),
    )


def run_audit(df: DataFrame) -> DataFrame:
    """One row a dataset of ``df(dataset, response, token_count, token_limit_reached, parsing_status, stop_reason, category)``.

    Counts and rates of truncation, parsing and stops, the summary of token counts, and failures by category.
    """
    n = F.count("*")
    failed = ~F.col("category").isin("correct", "useful")
    return df.groupBy("dataset").agg(
        n.alias("collected_count"),
        F.count_if("token_limit_reached").alias("truncation_count"),
        (F.count_if("token_limit_reached") / n).alias("truncation_rate"),
        F.count_if(F.coalesce("parsing_status", F.lit("ok")) != "ok").alias("parsing_failure_count"),
        (F.count_if(F.col("stop_reason") == "eos_token") / n).alias("eos_rate"),
        (F.count_if(F.col("stop_reason") == "token_limit") / n).alias("token_limit_rate"),
        F.count_if(F.trim(F.coalesce("response", F.lit(""))) == "").alias("empty_response_count"),
        F.min("token_count").alias("minimum"),
        F.percentile("token_count", 0.5).alias("median"),
        F.avg("token_count").alias("mean"),
        F.max("token_count").alias("maximum"),
        F.count_if(failed).alias("failure_example_count"),
    )
