"""Text columns: normalised words, alias matching, segments, numbers, abstention and repetition."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrays import bound

#: Articles that normalisation drops, and ASCII punctuation.
ARTICLES = ("a", "an", "the")
PUNCTUATION = r"[!-/:-@\[-`{-~]"
BLANKS = r"[ \t\n\r]+"
#: A blank and a word's character as Python reads them, whatever the script; digits of numbers are ASCII.
_S, _W = r"[\s\x1c-\x1f\x85\p{Z}]", r"\p{L}\p{N}_"
#: What counts as a number, a fraction, an explicit final answer and a boxed one.
_DIGITS = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
NUMBER = rf"(?<![{_W}/]){_DIGITS}(?![{_W}/])"
FRACTION = rf"[-+]?\d+{_S}*/{_S}*\d+"
FINAL = rf"(?i)(?:####|final{_S}+answer{_S}*(?:is|:)?|answer{_S}*(?:is|:)?){_S}*({_DIGITS})"
BOXED = rf"\\boxed\{{{_S}*({_DIGITS}){_S}*\}}"
#: The last line that states an answer, breaks between segments, list marks and numbered lines.
ANSWER_LINE = rf"(?i)(?:^|\n)Final answer:{_S}*({_DIGITS})"
SEGMENT_BREAK = rf"\n+|;+|{_S}+[•●▪]{_S}+"
LIST_MARK = rf"^{_S}*(?:[-*•]|\d+[.)]){_S}*"
NUMBERED = rf"(?m)^{_S}*(\d+)[.)]{_S}*(.+?){_S}*$"
#: A word as Python reads \w: letters, digits and the underscore of any script.
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-case words without ASCII punctuation and articles; null gives an empty array."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(flat, BLANKS), lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalised(text: Column) -> Column:
    return F.concat_ws(" ", words(text))


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition, which Spark has no function for."""
    for part in texts:
        yield part.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


#: Words of both sides up to which each is sought rather than sorted.
FEW_WORDS = 24


def _common(a: Column, b: Column) -> Column:
    sought = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    tagged = lambda x, side: F.transform(x, lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    both = F.sort_array(F.concat(tagged(a, 0), tagged(b, 1)))  # of each word those of ``a`` first
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("free"), F.lit(0).alias("k"))

    def step(s: Column, x: Column) -> Column:
        free = F.when(s["w"] == x["w"], s["free"]).otherwise(0)  # of ``a``, without one of ``b`` so far
        pair = F.when((x["side"] == 1) & (free > 0), 1).otherwise(0)
        return F.struct(x["w"].alias("w"), F.when(x["side"] == 0, free + 1).otherwise(free - pair).alias("free"), (s["k"] + pair).alias("k"))

    return F.when(F.size(a) + F.size(b) <= FEW_WORDS, sought).otherwise(F.aggregate(both, start, step, lambda s: s["k"]))


def common_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays without nulls: short ones are gone through for each word, long ones sorted together."""
    return bound(a, lambda a: bound(b, lambda b: _common(a, b)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two word arrays: 1 if both are empty, 0 if one is."""
    return bound(a, lambda a: bound(b, lambda b: _f1(a, b)))


def _f1(a: Column, b: Column) -> Column:
    k, total = _common(a, b), F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.lit(2.0) * k / total)


def without_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", " "), " +", " "))


def concise_rule(response: Column, alias: Column, most_extra: int = 8) -> Column:
    """Which rule accepts a short response: exact, exact without a bracketed part, or the alias as its end."""
    r, a = normalised(response), normalised(alias)
    extra = F.size(words(response)) - F.size(words(alias))
    return (  # fixed values: the names of the rules
        F.when(r == a, "normalized_exact")
        .when(normalised(without_parentheses(response)) == a, "response_parenthetical")
        .when(r == normalised(without_parentheses(alias)), "alias_parenthetical")
        .when((a != "") & F.endswith(r, a) & (extra <= most_extra), "concise_containment")
    )


def segments(text: Column) -> Column:
    """Parts between newlines, semicolons and spaced bullets, list marks stripped; the whole text if none is left."""
    parts = F.transform(F.split(text, SEGMENT_BREAK), lambda s: F.regexp_replace(F.regexp_replace(s, LIST_MARK, ""), r"^[ \t,]+|[ \t,]+$", ""))
    kept = F.filter(parts, lambda s: s != "")
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.size(kept) > 0, kept).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def numbered(text: Column) -> Column:
    """array of struct(place, text) of the lines that begin with a number and a dot or bracket; places from 0, null for numbers of over 18 digits."""
    part = lambda i: F.regexp_extract_all(text, F.lit(NUMBERED.replace("(?m)", "(?dm)")), i)  # noqa: E731  lines end at \\n alone
    place = lambda n: F.when(F.length(n) <= 18, n.cast("long") - 1)  # noqa: E731  no list has longer numbers
    return F.transform(F.arrays_zip(part(1).alias("n"), part(2).alias("t")), lambda x: F.struct(place(x["n"]).alias("place"), F.trim(x["t"]).alias("text")))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)


def plain_number(text: Column) -> Column:
    """Digits without commas, sign plus, leading zeros and an all-zero fraction; minus zero is zero."""
    flat = F.regexp_replace(F.regexp_replace(F.trim(text), "[,+$]", ""), r"\.0*$", "")
    return F.regexp_replace(F.regexp_replace(flat, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")


#: Why a response has no integer answer.
EMPTY, IS_FRACTION, NO_NUMBER = "empty_or_nonnumeric_response", "fraction_not_allowed", "no_numeric_answer"
SEVERAL, NOT_INTEGER = "ambiguous_multiple_numbers", "non_integer_answer"


def _judged(text: Column, found: Column) -> Column:
    value, parsed = plain_number(F.get(found, 0)), F.get(found, 0)
    reason = (
        F.when(F.regexp_replace(text, _S, "") == "", EMPTY)
        .when(text.rlike(FRACTION), IS_FRACTION)
        .when(F.size(found) == 0, NO_NUMBER)
        .when(F.size(found) > 1, SEVERAL)
        .when(value.contains("."), NOT_INTEGER)
    )
    ok = reason.isNull()
    return F.struct(F.when(ok | (reason == NOT_INTEGER), parsed).alias("parsed"), F.when(ok, value).alias("value"), F.when(ok, "ok").otherwise("error").alias("status"), reason.alias("reason"))


def _all(pattern: str, text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def integer_answer(text: Column) -> Column:
    """struct(parsed, value, status, reason): the number of the last explicit final answer, else the only number of the text."""
    t = F.coalesce(text, F.lit(""))
    finals = _all(FINAL, t)
    return _judged(t, F.when(F.size(finals) > 0, F.slice(finals, -1, 1)).otherwise(numbers(t)))


def final_number(text: Column) -> Column:
    """struct(parsed, value, status, reason) of the last boxed number, else the last explicit answer, else the last number.

    A text without any is judged as a whole: it may hold a fraction.
    """
    t = F.coalesce(text, F.lit(""))
    boxed, finals, every = _all(BOXED, t), _all(FINAL, t), numbers(t)
    last = F.coalesce(F.try_element_at(boxed, F.lit(-1)), F.try_element_at(finals, F.lit(-1)), F.try_element_at(every, F.lit(-1)))
    return _judged(F.coalesce(last, t), F.when(last.isNotNull(), F.array(last)).otherwise(F.array().cast("array<string>")))


def arithmetic_match(response: Column, reference: Column, final: bool = False) -> Column:
    """Whether the integer answer equals the reference; a reference that is no integer is an error."""
    right = F.when(reference.rlike(r"^\s*[-+]?[0-9,]+(\.0*)?\s*$"), plain_number(reference)).otherwise(F.raise_error(F.concat(F.lit("reference is not an integer: "), F.coalesce(reference, F.lit("null")))).cast("string"))
    answer = (final_number if final else integer_answer)(response)
    return F.coalesce(answer["value"] == right, F.lit(False))


#: Phrases that decline to answer, sought in normalised text (where apostrophes are gone), and the rule of the one word.
ABSTENTIONS = (
    r"\b(?:cannot|can't|could not)\s+be\s+determined\b",
    r"\b(?:not|isn't|is not)\s+(?:provided|stated|specified|mentioned)\b",
    r"\binsufficient\s+(?:information|context)\b",
    r"\bcontext\s+(?:does not|doesn't)\s+(?:say|state|provide|mention)\b",
    r"\bunknown\s+from\s+(?:the\s+)?passage\b",
)
CANONICAL = "canonical"
#: The one word that is an abstention, what a failed one holds, and phrases of refusal or doubt.
UNANSWERABLE, HALF_ABSTAINED = "unanswerable", ("unknown", "unanswer")
REFUSALS = ("i don't know", "i do not know", "cannot answer", "uncertain")


def abstention(text: Column) -> Column:
    """The rule by which a response abstains: ``canonical`` for an empty one and the one word, else the pattern; null if it doesn't."""
    flat = normalised(text)
    out = F.when(flat.isin("", UNANSWERABLE), CANONICAL)
    for pattern in ABSTENTIONS:
        out = out.when(flat.rlike(pattern), pattern)
    return out


def _holds_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(phrase))
    return out


def refusal(text: Column) -> Column:
    return _holds_any(F.lower(F.coalesce(text, F.lit(""))), REFUSALS)


def malformed_abstention(text: Column, flat: bool = False) -> Column:
    """Words of an abstention in a response that isn't one, sought in the response in lower case or, with ``flat``, normalised."""
    where = normalised(text) if flat else F.lower(F.coalesce(text, F.lit("")))
    return _holds_any(where, HALF_ABSTAINED) & abstention(text).isNull()


def repetition(items: Column) -> Column:
    """1 - distinct / all; 0 for an empty array."""
    return F.when(F.size(items) == 0, 0.0).otherwise(1.0 - F.size(F.array_distinct(items)) / F.size(items))


def ngrams(items: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.concat_ws(" ", F.slice(items, i, F.lit(n))))
    return F.when(F.size(items) >= n, runs).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Words of any script in lower case, with articles."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def sentences(text: Column) -> Column:
    """The words of each sentence: parts after a full stop, exclamation or question mark before a blank, or at newlines."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.array_join(tokens(s), " "))
    return F.filter(parts, lambda s: s != "")


#: Repetition above which a response is taken to loop.
LOOP = 0.5


def loops(ngram_rate: Column, sentence_rate: Column) -> Column:
    return F.greatest(ngram_rate, sentence_rate) > LOOP


def last_answer(text: Column) -> Column:
    """struct(place, relative, trailing) of the last line that states an answer; places in characters from 0, null without one."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, ANSWER_LINE)  # what stands between the lines
    after = F.element_at(parts, -1)
    marks = F.regexp_extract_all(t, F.lit(ANSWER_LINE), 0)
    place = F.length(t) - F.length(after) - F.length(F.element_at(marks, -1))
    there = F.size(marks) > 0
    return F.struct(F.when(there, place).alias("place"), F.when(there, place / F.greatest(F.lit(1), F.length(t))).alias("relative"), F.when(there, after).alias("trailing"))
