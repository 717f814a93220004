"""Registered queries that grade responses. The records are stand-ins made of ``part`` by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions import text as T
from ..operators import aliases as aliases_
from .text_queries import norm_sql, read, words_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Responses to a part's name, by a running number: exact, in a sentence, bracketed, numbered, cut, abstaining, refusing, wrong.
_TEXTS = (
    "p_name",
    "'It is the ' || p_name || '.'",
    "p_name || ' (' || p_brand || ')'",
    "p_name || ' is what ' || p_type || ' buyers want most'",
    "'1. ' || p_name || chr(10) || '2. ' || lower(p_type)",
    "p_name || '; - ' || p_type || ' • nothing'",
    "'Unanswerable'",
    "'It cannot be determined from the passage'",
    "'I don''t know, uncertain'",
    "''",
    "second",
    "'unknown thing ' || p_type",
    "'1) ' || lower(p_type) || chr(10) || '2) ' || p_name",
)
_NUMBERS = (
    "'The final answer is ' || size",
    "'5 + 3 = 8' || chr(10) || '#### ' || size",
    "'so 12 then ' || chr(92) || 'boxed' || chr(123) || size || chr(125) || ' and 4'",
    "size || ' and 7'",
    "size || '/3'",
    "'no idea'",
    "''",
    "size || '.5'",
    "'it is -0'",
    "'é' || size",
    "'+' || size || '.00'",
    "'answer: 1,0' || lpad(size, 2, '0')",
    "size",
)


def records_sql(array: str, record: str, source: str = "part") -> str:
    """(id, dataset, response, aliases, wrong_aliases, answerable, interpretations); ``array`` and ``record`` say how an engine writes them."""
    pick = lambda options, n: " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options)) + f" ELSE {options[0]} END"
    one = record.format("'a'", array.format("p_name, second"))
    two = record.format("'b'", "CASE WHEN p_partkey % 5 = 0 THEN " + array.format("lower(p_type), p_name") + " ELSE " + array.format("lower(p_type)") + " END")
    return f"""SELECT p_partkey AS id, dataset, CASE WHEN dataset IN ('gsm8k', 'arithmetic') THEN CASE CAST(floor(p_partkey / 6) AS INT) % {len(_NUMBERS)} {pick(_NUMBERS, 0)}
ELSE CASE CAST(floor(p_partkey / 6) AS INT) % {len(_TEXTS)} {pick(_TEXTS, 0)} END AS response,
CASE WHEN dataset IN ('gsm8k', 'arithmetic') THEN {array.format("size")} ELSE {array.format("p_name, p_name || ' (' || p_type || ')', 'the ' || p_brand")} END AS aliases,
{array.format("lower(p_type), 'nothing ' || second")} AS wrong_aliases, p_partkey % 4 <> 0 AS answerable,
CASE WHEN p_partkey % 7 = 0 THEN {array.format(one)} ELSE {array.format(one + ", " + two)} END AS interpretations, p_partkey % 7 = 0 AS single, p_brand AS brand, size
FROM (SELECT *, split(p_name, ' ')[{{second}}] AS second, CAST(p_size AS STRING) AS size, CASE p_partkey % 6 WHEN 0 THEN 'triviaqa' WHEN 1 THEN 'ambignq' WHEN 2 THEN 'squad' WHEN 3 THEN 'truthfulqa' WHEN 4 THEN 'gsm8k' ELSE 'arithmetic' END AS dataset FROM {source})"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Rows are few bytes but much work each: they are dealt out by number, as one file of them would be one task."""
    part = read(spark, sf, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return spark.sql(records_sql("array({})", "named_struct('name', {}, 'aliases', {})", "{part}").replace("{second}", "1"), part=part)


_RECORDS = records_sql("[{}]", "{{'name': {}, 'aliases': {}}}").replace("{second}", "2").replace("AS STRING", "AS VARCHAR")


def flat_sql(x: str) -> str:
    """Normalised without brackets."""
    return norm_sql(f"trim(regexp_replace(regexp_replace({x}, '\\([^()]*\\)', ' ', 'g'), ' +', ' ', 'g'))")


def f1_sql(a: str, b: str) -> str:
    common = f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0)"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {common} / (len({a}) + len({b})) END"


def prepared_sql(source: str, response: str = "response", **lists: str) -> str:
    """``source`` with rn, rw, rp and for each list its n, w, p and F1 scores."""
    forms = "".join(f", list_transform({c}, lambda a: {norm_sql('a')}) AS {k}n, list_transform({c}, lambda a: {words_sql('a')}) AS {k}w, list_transform({c}, lambda a: {flat_sql('a')}) AS {k}p" for k, c in lists.items())
    scores = "".join(f", list_transform({k}w, lambda q: {f1_sql('rw', 'q')}) AS {k}f" for k in lists)
    return f"SELECT *{scores} FROM (SELECT *, {norm_sql(response)} AS rn, {words_sql(response)} AS rw, {flat_sql(response)} AS rp{forms} FROM ({source}))"


def concise_sql(k: str) -> str:
    return f"CASE WHEN list_contains({k}n, rn) THEN 'normalized_exact' WHEN list_contains({k}n, rp) THEN 'response_parenthetical' WHEN list_contains({k}p, rn) THEN 'alias_parenthetical' WHEN list_min(list_transform(list_filter({k}w, lambda w: len(w) > 0 AND suffix(rn, array_to_string(w, ' '))), lambda w: len(rw) - len(w))) <= 8 THEN 'concise_containment' END"


_QUOTED = [p.replace("'", "''") for p in T.ABSTENTIONS]
_ABSTAINED = "CASE WHEN rn IN ('', 'unanswerable') THEN 'canonical' " + " ".join(f"WHEN regexp_matches(rn, '{p}') THEN '{p}'" for p in _QUOTED) + " END"
_REFUSED = "(" + " OR ".join(f"contains(lower(response), '{x.replace(chr(39), chr(39) * 2)}')" for x in T.REFUSALS) + ")"
_INSIDE = "list_transform(list_filter(range(len(an)), lambda i: an[i + 1] <> '' AND contains(rn, an[i + 1])), lambda i: aliases[i + 1])"
_AROUND = "list_transform(list_filter(range(len(an)), lambda i: rn <> '' AND contains(an[i + 1], rn)), lambda i: aliases[i + 1])"
_A = prepared_sql(_RECORDS, a="aliases")
_AB = prepared_sql(_RECORDS, a="aliases", b="wrong_aliases")


def _prepared(spark, sf, **lists):
    return G.prepared(records(spark, sf), "response", **lists)


def r6(x):
    return F.round(x, 6)


@query(f"SELECT id, list_contains(an, rn) AS exact, round(list_max(af), 6) AS f1, len(list_filter(an, lambda a: a = rn))::INT AS matched FROM ({_A})")
def alias_scores(spark, sf):
    return _prepared(spark, sf, a="aliases").select("id", G.exact("a").alias("exact"), r6(G.best_f1("a")).alias("f1"), F.size(G.matched("a")).alias("matched"))


@query(f"SELECT id, list_contains(an, rn) AS exact, len({_INSIDE}) > 0 AS alias_in_response, len({_AROUND}) > 0 AS response_in_alias, array_to_string({_INSIDE}, '|') AS inside, array_to_string({_AROUND}, '|') AS around, round(list_max(af), 6) AS f1, aliases[list_position(af, list_max(af))] AS best FROM ({_A})")
def containment_bundle(spark, sf):
    x = _prepared(spark, sf, a="aliases").select("id", G.containment("a", "aliases").alias("c"))
    return x.select("id", "c.exact", "c.alias_in_response", "c.response_in_alias", F.concat_ws("|", "c.contained_aliases").alias("inside"), F.concat_ws("|", "c.containing_aliases").alias("around"), r6(F.col("c.best_f1")).alias("f1"), F.col("c.best_alias").alias("best"))


#: One question whose aliases are the names, types and brands of all parts; answers are the records' responses.
_MANY = f"SELECT DISTINCT {norm_sql('x')} AS a FROM (SELECT unnest([p_name, p_type, p_brand, 'the ' || p_type || ' ' || p_name]) AS x FROM part)"


@query(f"""WITH a AS MATERIALIZED (SELECT a, {words_sql('a')} AS aw FROM ({_MANY})), r AS MATERIALIZED (SELECT id, rn, rw FROM ({prepared_sql(_RECORDS)})), d AS MATERIALIZED (SELECT DISTINCT rn, rw FROM r),
m AS MATERIALIZED (SELECT rn, count(*) FILTER (WHERE a = rn) AS exact, count(*) FILTER (WHERE a <> '' AND contains(rn, a)) AS contained, max({f1_sql('rw', 'aw')}) AS f1 FROM d, a GROUP BY rn)
SELECT id, exact > 0 AS exact, contained, round(f1, 6) AS best_f1 FROM r JOIN m USING (rn)""")
def many_aliases(spark, sf):
    """Every response against the aliases of all parts, by indexes."""
    p = read(spark, sf, "part")
    aliases = p.select(F.lit(1).alias("q"), F.explode(F.array("p_name", "p_type", "p_brand", F.concat(F.lit("the "), "p_type", F.lit(" "), "p_name"))).alias("alias"))
    one, two = aliases_.prepared(records(spark, sf).withColumn("q", F.lit(1)), aliases, "q", "id", "response", "alias")
    exact_ = aliases_.exact_matches(one, two).select("id").distinct().withColumn("exact", F.lit(True))
    inside = aliases_.contained(one, two).groupBy("id").agg(F.countDistinct("a").alias("contained"))
    out = aliases_.best_overlap(one, two).join(exact_, "id", "left").join(inside, "id", "left")
    return out.select("id", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("contained", F.lit(0).cast("long")).alias("contained"), r6(F.col("best_f1")).alias("best_f1"))


@query(f"SELECT id, {concise_sql('a')} AS rule FROM ({_A})")
def concise_aliases(spark, sf):
    return _prepared(spark, sf, a="aliases").select("id", G.concise("a").alias("rule"))


@query(f"""SELECT id, len(n)::INT AS lines, array_to_string(list_transform(n, lambda x: (x::INT - 1)::VARCHAR), ',') AS places, array_to_string(t, '|') AS texts
FROM (SELECT id, regexp_extract_all(response, '{T.NUMBERED}', 1) AS n, regexp_extract_all(response, '{T.NUMBERED}', 2) AS t FROM ({_RECORDS}))""")
def numbered_lines(spark, sf):
    x = records(spark, sf).select("id", T.numbered(F.col("response")).alias("x"))
    return x.select("id", F.size("x").alias("lines"), F.concat_ws(",", F.transform("x", lambda v: v["place"].cast("string"))).alias("places"), F.concat_ws("|", F.transform("x", lambda v: v["text"])).alias("texts"))


_PARTS = f"""list_filter(list_transform(regexp_split_to_array(response, '{T.SEGMENT_BREAK}'), lambda s: regexp_replace(regexp_replace(s, '{T.LIST_MARK}', ''), '^[ \\t,]+|[ \\t,]+$', '', 'g')), lambda s: s <> '')"""
_CUT = f"""SELECT *, CASE WHEN len(lines) > 0 THEN regexp_extract_all(response, '{T.NUMBERED}', 2) WHEN len(parts) > 0 THEN parts WHEN trim(response) <> '' THEN [trim(response)] ELSE [] END AS segs
FROM (SELECT *, regexp_extract_all(response, '{T.NUMBERED}', 1) AS lines, {_PARTS} AS parts FROM ({{source}}))"""


@query(f"SELECT id, len(segs)::INT AS segments, array_to_string(segs, '|') AS texts FROM ({_CUT.replace('{source}', _RECORDS)})")
def segment_texts(spark, sf):
    """Numbered lines, else segments."""
    x = records(spark, sf).select("id", T.numbered(F.col("response")).alias("n"), T.segments(F.col("response")).alias("s"))
    segs = F.when(F.size("n") > 0, F.transform("n", lambda v: v["text"])).otherwise(F.col("s"))
    return x.select("id", F.size(segs).alias("segments"), F.concat_ws("|", segs).alias("texts"))


def coverage_sql(source: str) -> str:
    each = f"SELECT id, response, lines, segs, unnest(range(len(interpretations))) AS k, interpretations FROM ({_CUT.replace('{source}', source)})"
    own = "CASE WHEN len(lines) > 0 THEN list_transform(list_filter(range(len(segs)), lambda i: lines[i + 1]::INT - 1 = k), lambda i: segs[i + 1]) ELSE segs END"
    whole = f"SELECT id, k, len(segs) AS n_segs, len(lines) > 0 AS by_number, interpretations[k + 1].aliases AS al, list_prepend(response, {own}) AS cands FROM ({each})"
    rows = f"SELECT id, k, n_segs, by_number, al, unnest(range(len(cands))) - 1 AS place, unnest(cands) AS part FROM ({whole})"
    judged = f"SELECT id, k, n_segs, place, ({concise_sql('a')}) IS NOT NULL AND (place >= 0 OR NOT by_number) AS m, list_max(af) AS f1 FROM ({prepared_sql(rows, 'part', a='al')})"
    by_k = f"SELECT id, k, bool_or(m) AS m, max(f1) AS f1, max(n_segs) AS n_segs, list(place) FILTER (WHERE m AND place >= 0) AS spots FROM ({judged}) GROUP BY id, k"
    return f"""SELECT id, count(*) AS interpretations, count(*) FILTER (WHERE m) AS covered, count(*) FILTER (WHERE m) / count(*) AS coverage, max(f1) AS best_f1, max(n_segs)::INT AS segments,
coalesce(len(list_distinct(flatten(list(coalesce(spots, []))))), 0)::INT AS matched_segments FROM ({by_k}) GROUP BY id"""


_COVER = coverage_sql(_RECORDS)


@query(f"SELECT id, interpretations, covered, round(coverage, 6) AS coverage, covered > 0 AS any_match, covered > 1 AS several, round(best_f1, 6) AS best_f1, segments, matched_segments FROM ({_COVER})")
def segment_coverage(spark, sf):
    c = G.coverage(records(spark, sf))
    return c.withColumns({"coverage": r6(F.col("coverage")), "best_f1": r6(F.col("best_f1"))})


_SHARED = f"""SELECT id, count(*) AS shared FROM (SELECT id, rn, alias, count(DISTINCT name) AS k FROM (SELECT id, rn, x.name AS name, unnest(list_transform(x.aliases, lambda a: {norm_sql('a')})) AS alias
FROM (SELECT id, {norm_sql('response')} AS rn, unnest(interpretations) AS x FROM ({_RECORDS}))) GROUP BY ALL) WHERE k > 1 AND alias <> '' AND contains(rn, alias) GROUP BY id"""
_LABELS = f"""SELECT *, CASE WHEN NOT unresolved THEN provisional END AS label FROM (SELECT *, CASE WHEN covered = 0 THEN 'incorrect' WHEN covered = interpretations AND "precision" = 1.0 THEN 'fully_correct' ELSE 'partially_correct' END AS provisional
FROM (SELECT c.*, CASE WHEN segments > 0 THEN least(1.0::DOUBLE, matched_segments / segments) ELSE 0.0::DOUBLE END AS "precision", shared IS NOT NULL AS unresolved FROM ({_COVER}) c LEFT JOIN ({_SHARED}) s USING (id)))"""


@query(f"""SELECT id, round("precision", 6) AS segment_precision, unresolved, provisional, label, CASE label WHEN 'incorrect' THEN 0 WHEN 'partially_correct' THEN 1 WHEN 'fully_correct' THEN 2 END AS ordinal,
(label = 'incorrect')::INT AS fully_wrong, (label <> 'fully_correct')::INT AS incomplete, greatest(0, segments - matched_segments)::INT AS unsupported FROM ({_LABELS})""")
def interpretation_labels(spark, sf):
    x = G.interpretation_labels(records(spark, sf))
    return x.select("id", r6(F.col("precision")).alias("segment_precision"), "unresolved", "provisional", "label", "ordinal", "fully_wrong", "incomplete", "unsupported")


@query(f"SELECT id, shared FROM ({_SHARED})")
def shared_alias_matches(spark, sf):
    return G.shared_aliases(records(spark, sf))


@query(f"""SELECT coalesce(label, 'unresolved') AS label, count(*) AS n, count(*) FILTER (WHERE NOT unresolved) AS kept, min(id) AS first_id FROM ({_LABELS}) JOIN (SELECT id FROM ({_RECORDS}) WHERE dataset = 'ambignq') USING (id) GROUP BY 1""")
def relabelled_classes(spark, sf):
    """New labels joined to the records, unresolved ones apart, with counts of each class."""
    rows = records(spark, sf).filter("dataset = 'ambignq'")
    x = rows.select("id").join(G.interpretation_labels(rows), "id")
    return x.groupBy(F.coalesce("label", F.lit("unresolved")).alias("label")).agg(F.count("*").alias("n"), F.count_if(~F.col("unresolved")).alias("kept"), F.min("id").alias("first_id"))


@query(f"""SELECT id, label, place FROM (SELECT id, coalesce(label, 'unresolved') AS label, row_number() OVER (PARTITION BY coalesce(label, 'unresolved') ORDER BY id) AS place FROM ({_LABELS})) WHERE place <= 20 OR label = 'unresolved'""")
def label_audit_sample(spark, sf):
    """The first twenty of each label by id, and all that are unresolved."""
    from pyspark.sql import Window

    x = G.interpretation_labels(records(spark, sf)).select("id", F.coalesce("label", F.lit("unresolved")).alias("label"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return x.filter("label <> 'unresolved'").withColumn("place", place.cast("long")).filter("place <= 20").unionByName(x.filter("label = 'unresolved'").withColumn("place", place.cast("long")))


@query(f"SELECT id, {_REFUSED} AS refused, (contains(lower(response), 'unknown') OR contains(lower(response), 'unanswer')) AND ({_ABSTAINED}) IS NULL AS malformed, (contains(rn, 'unknown') OR contains(rn, 'unanswer')) AND ({_ABSTAINED}) IS NULL AS malformed_flat, {_ABSTAINED} AS abstained FROM ({_A})")
def refusals_and_abstentions(spark, sf):
    r = F.col("response")
    return records(spark, sf).select("id", T.refusal(r).alias("refused"), T.malformed_abstention(r).alias("malformed"), T.malformed_abstention(r, flat=True).alias("malformed_flat"), T.abstention(r).alias("abstained"))


_STATUS = "CASE WHEN list_contains(an, rn) AND list_contains(bn, rn) THEN 'matched_both_reference_sets' WHEN list_contains(an, rn) THEN 'matched_correct_reference' WHEN list_contains(bn, rn) THEN 'matched_incorrect_reference' ELSE 'unmatched' END"


@query(f"SELECT id, {_STATUS} AS status, round(list_max(af), 6) AS right_f1, round(list_max(bf), 6) AS wrong_f1 FROM ({_AB})")
def truth_status(spark, sf):
    x = _prepared(spark, sf, a="aliases", b="wrong_aliases")
    return x.select("id", G.truth_status("a", "b").alias("status"), r6(G.best_f1("a")).alias("right_f1"), r6(G.best_f1("b")).alias("wrong_f1"))


_RECALL = f"""SELECT id, count(*) AS interpretations, count(*) FILTER (WHERE list_contains(an, rn)) AS matched, avg(list_max(af)) AS mean_f1 FROM ({prepared_sql(f"SELECT id, response, x.aliases AS al FROM (SELECT id, response, unnest(interpretations) AS x FROM ({_RECORDS}))", a="al")}) GROUP BY id"""


@query(f"SELECT id, interpretations, matched, matched > 0 AS any_match, round(matched / interpretations, 6) AS recall, round(mean_f1, 6) AS mean_f1 FROM ({_RECALL})")
def ambiguous_recall(spark, sf):
    return G.recall(records(spark, sf)).withColumns({"recall": r6(F.col("recall")), "mean_f1": r6(F.col("mean_f1"))})


@query(f"SELECT id, CASE WHEN answerable THEN list_contains(an, rn) ELSE rn IN ('', 'unanswerable') END AS correct, round(CASE WHEN answerable THEN list_max(af) ELSE (rn IN ('', 'unanswerable'))::DOUBLE END, 6) AS f1, CASE WHEN NOT answerable THEN (rn IN ('', 'unanswerable'))::DOUBLE END AS no_answer FROM ({_A}) WHERE dataset = 'squad'")
def span_answers(spark, sf):
    x = _prepared(spark, sf, a="aliases").filter("dataset = 'squad'").select("id", G.span_scores("a", "answerable").alias("s"))
    return x.select("id", "s.correct", r6(F.col("s.f1")).alias("f1"), "s.no_answer")


_DIGITS = "[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\\.[0-9]+)?"
_FINALS = f"regexp_extract_all(response, '(?i)(?:####|final\\s+answer\\s*(?:is|:)?|answer\\s*(?:is|:)?)\\s*({_DIGITS})', 1)"
_BOXED = f"regexp_extract_all(response, '\\\\boxed\\{{\\s*({_DIGITS})\\s*\\}}', 1)"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[,+]', '', 'g'), '\\.0*$', ''), '^(-?)0+([0-9])', '\\1\\2'), '^-0$', '0')"
_ARITH = f"""SELECT id, dataset, aliases[1] AS reference, response, CASE WHEN response = '' THEN 'empty_or_nonnumeric_response' WHEN (dataset = 'arithmetic' OR len(found) = 0) AND regexp_matches(response, '[0-9]+\\s*/\\s*[0-9]+') THEN 'fraction_not_allowed' WHEN len(found) = 0 THEN 'no_numeric_answer'
WHEN len(found) > 1 THEN 'ambiguous_multiple_numbers' WHEN contains({_PLAIN.format('found[1]')}, '.') THEN 'non_integer_answer' END AS reason, {_PLAIN.format('found[1]')} AS value
FROM (SELECT *, CASE WHEN dataset = 'gsm8k' THEN list_filter([coalesce(list_last(boxed), list_last(finals), list_last(every))], lambda x: x IS NOT NULL) WHEN len(finals) > 0 THEN [list_last(finals)] ELSE every END AS found
FROM (SELECT *, {_FINALS} AS finals, {_BOXED} AS boxed, regexp_extract_all(regexp_replace(regexp_replace(response, '[0-9]+/[0-9]+', ' ', 'g'), '\\p{{L}}[0-9]+', ' ', 'g'), '{_DIGITS}') AS every FROM ({_RECORDS}) WHERE dataset IN ('gsm8k', 'arithmetic')))"""


@query(f"SELECT id, CASE WHEN reason IS NULL THEN value END AS value, reason, reason IS NULL AND value = reference AS correct FROM ({_ARITH})")
def arithmetic_answers(spark, sf):
    x = records(spark, sf).filter("dataset in ('gsm8k', 'arithmetic')")
    r, first, final = F.col("response"), F.get("aliases", F.lit(0)), F.col("dataset") == "gsm8k"
    x = x.select("id", F.when(final, T.final_number(r)).otherwise(T.integer_answer(r)).alias("a"), F.when(final, T.arithmetic_match(r, first, True)).otherwise(T.arithmetic_match(r, first)).alias("correct"))
    return x.select("id", "a.value", "a.reason", "correct")


_VERDICT = f"""SELECT r.id, r.dataset, CASE r.dataset WHEN 'triviaqa' THEN list_contains(an, rn) WHEN 'squad' THEN CASE WHEN answerable THEN list_contains(an, rn) ELSE ({_ABSTAINED}) IS NOT NULL END WHEN 'ambignq' THEN m.matched > 0
WHEN 'truthfulqa' THEN NULL ELSE (SELECT reason IS NULL AND value = reference FROM ({_ARITH}) x WHERE x.id = r.id) END AS correct FROM ({_A}) r LEFT JOIN ({_RECALL}) m ON r.id = m.id"""


@query(f"SELECT id, dataset, correct, (NOT correct)::INT AS error, correct IS NULL AS unresolved FROM ({_VERDICT})")
def graded_responses(spark, sf):
    return G.graded(records(spark, sf))


@query(f"SELECT dataset, count(*) AS n, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE NOT correct) AS wrong, count(*) FILTER (WHERE correct IS NULL) AS unresolved, round(avg(correct::INT), 6) AS accuracy FROM ({_VERDICT}) GROUP BY dataset")
def consolidated_report(spark, sf):
    """One row a dataset."""
    g = G.graded(records(spark, sf))
    return g.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("wrong"), F.count_if("unresolved").alias("unresolved"), r6(F.avg(F.col("correct").cast("int"))).alias("accuracy"))


_SIDE = "CASE WHEN abs(list_max(af) - list_max(bf)) < 0.05 THEN 'neither' WHEN list_max(af) > list_max(bf) THEN 'correct_reference_leaning' ELSE 'incorrect_reference_leaning' END"


@query(f"SELECT id, CASE WHEN {_REFUSED} THEN 'refusal_or_uncertainty' ELSE {_SIDE} END AS leaning FROM ({_AB}) WHERE dataset = 'truthfulqa'")
def lexical_leaning(spark, sf):
    return _prepared(spark, sf, a="aliases", b="wrong_aliases").filter("dataset = 'truthfulqa'").select("id", G.leaning("response", "a", "b").alias("leaning"))


@query(f"""SELECT r.id, dataset, CASE dataset WHEN 'triviaqa' THEN coalesce({concise_sql('a')}, CASE WHEN list_max(af) > 0 THEN 'token_overlap' ELSE 'clearly_incorrect' END)
WHEN 'ambignq' THEN CASE WHEN covered > 1 THEN 'multiple_interpretations' WHEN covered > 0 THEN 'one_interpretation' WHEN best_f1 >= 0.5 THEN 'high_overlap_unresolved' ELSE 'clearly_incorrect' END
WHEN 'squad' THEN CASE WHEN answerable THEN 'unchanged' ELSE coalesce({_ABSTAINED}, 'unsupported_answer') END
WHEN 'truthfulqa' THEN CASE WHEN list_contains(an, rn) AND list_contains(bn, rn) THEN 'both' WHEN list_contains(an, rn) THEN 'correct_reference_leaning' WHEN list_contains(bn, rn) THEN 'incorrect_reference_leaning' ELSE {_SIDE} END ELSE 'unchanged' END AS status,
CASE WHEN dataset = 'triviaqa' THEN ({concise_sql('a')}) IS NOT NULL WHEN dataset = 'ambignq' THEN covered > 0 WHEN dataset = 'squad' AND NOT answerable THEN ({_ABSTAINED}) IS NOT NULL WHEN dataset <> 'truthfulqa' THEN v.correct END AS correct
FROM ({_AB}) r LEFT JOIN ({_COVER}) c ON r.id = c.id JOIN (SELECT id AS vid, correct FROM ({_VERDICT})) v ON r.id = v.vid""")
def revised_status(spark, sf):
    return G.revised(records(spark, sf))


_CATEGORY = f"""CASE WHEN list_contains(aliases, response) THEN 'exact_alias_match' WHEN list_contains(an, rn) THEN 'normalized_alias_match' WHEN ({concise_sql('a')}) IS NOT NULL THEN 'alias_in_concise_response' WHEN len({_INSIDE}) > 0 THEN 'alias_contained_diagnostic_only'
WHEN len({_AROUND}) > 0 THEN 'response_contained_in_alias' WHEN list_max(af) >= 0.5 THEN 'token_overlap_match' WHEN list_max(af) < 0.2 THEN 'clearly_incorrect' ELSE 'unclear' END"""


@query(f"SELECT {_CATEGORY} AS category, count(*) AS n, min(id) AS first_id FROM ({_A}) GROUP BY 1")
def alias_categories(spark, sf):
    """Kinds of responses; the recorded match is taken to be that of the texts as they are."""
    x = _prepared(spark, sf, a="aliases")
    kind = G.alias_category("a", "aliases", F.array_contains("aliases", F.col("response")))
    return x.groupBy(kind.alias("category")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""SELECT answerable, a IS NOT NULL AS abstained, count(*) AS n, count(*) FILTER (WHERE answerable AND a IS NOT NULL) AS false_abstentions, count(*) FILTER (WHERE NOT answerable AND a IS NULL) AS unsupported, count(*) FILTER (WHERE malformed) AS malformed
FROM (SELECT answerable, {_ABSTAINED} AS a, (contains(lower(response), 'unknown') OR contains(lower(response), 'unanswer')) AND ({_ABSTAINED}) IS NULL AS malformed FROM ({_A})) GROUP BY 1, 2""")
def abstention_confusion(spark, sf):
    r = F.col("response")
    x = records(spark, sf).select("answerable", T.abstention(r).isNotNull().alias("abstained"), T.malformed_abstention(r).alias("m"))
    ok, a = F.col("answerable"), F.col("abstained")
    return x.groupBy("answerable", "abstained").agg(F.count("*").alias("n"), F.count_if(ok & a).alias("false_abstentions"), F.count_if(~ok & ~a).alias("unsupported"), F.count_if("m").alias("malformed"))


#: Stand-ins for what a collection records beside the response: tokens are words of the response, the limit is eight of them.
_RUN = "SELECT *, {count} AS token_count, {count} >= 8 AS token_limit_reached, CASE WHEN {count} >= 8 THEN 'token_limit' WHEN id % 9 = 0 THEN 'other' ELSE 'eos_token' END AS stop_reason, CASE WHEN dataset IN ('gsm8k', 'arithmetic') THEN CASE WHEN response = '' THEN 'error' ELSE 'ok' END END AS parsing_status FROM {rows}"
_RUN_SQL = _RUN.format(count="CAST(len(string_split(response, ' ')) AS INT)", rows=f"({_RECORDS})")
_CATEGORISED = f"""SELECT v.dataset, r.*EXCLUDE (dataset), CASE WHEN v.dataset = 'ambignq' THEN CASE WHEN label IS NULL THEN 'unresolved' WHEN label = 'incorrect' THEN 'fully_incorrect' ELSE 'useful' END WHEN token_limit_reached THEN 'token_limit' WHEN correct THEN 'correct' ELSE 'incorrect' END AS category
FROM ({_VERDICT}) v JOIN ({_RUN_SQL}) r ON v.id = r.id LEFT JOIN ({_LABELS}) l ON v.id = l.id"""


def _categorised(spark, sf):
    rows = spark.sql(_RUN.format(count="size(split(response, ' '))", rows="{records}"), records=records(spark, sf))
    labels = G.interpretation_labels(rows.filter("dataset = 'ambignq'")).select("id", "label")
    x = rows.join(G.graded(rows).select("id", "correct"), "id").join(labels, "id", "left")
    useful = F.when(F.col("label").isNull(), "unresolved").when(F.col("label") == "incorrect", "fully_incorrect").otherwise("useful")
    return x.withColumn("category", F.when(F.col("dataset") == "ambignq", useful).when(F.col("token_limit_reached"), "token_limit").when(F.col("correct"), "correct").otherwise("incorrect"))


@query(f"SELECT dataset, category, count(*) AS n, round(avg(length(response)), 6) AS mean_chars, count(*) FILTER (WHERE category NOT IN ('correct', 'useful')) AS failures FROM ({_CATEGORISED}) GROUP BY ALL")
def failure_audit(spark, sf):
    """Why responses fail, by dataset."""
    return _categorised(spark, sf).groupBy("dataset", "category").agg(F.count("*").alias("n"), r6(F.avg(F.length("response"))).alias("mean_chars"), F.count_if(~F.col("category").isin("correct", "useful")).alias("failures"))


@query(f"""SELECT dataset, count(*) AS collected_count, count(*) FILTER (token_limit_reached) AS truncation_count, round(count(*) FILTER (token_limit_reached) / count(*), 6) AS truncation_rate, count(*) FILTER (parsing_status <> 'ok') AS parsing_failure_count,
round(count(*) FILTER (stop_reason = 'eos_token') / count(*), 6) AS eos_rate, round(count(*) FILTER (stop_reason = 'token_limit') / count(*), 6) AS token_limit_rate, count(*) FILTER (trim(response) = '') AS empty_response_count,
min(token_count) AS minimum, quantile_cont(token_count::DOUBLE, 0.5) AS median, round(avg(token_count), 6) AS mean, max(token_count) AS maximum, count(*) FILTER (category NOT IN ('correct', 'useful')) AS failure_example_count FROM ({_CATEGORISED}) GROUP BY dataset""")
def run_audits(spark, sf):
    """How each dataset's responses ended: truncation, parsing, stops, token counts and failures."""
    return G.run_audit(_categorised(spark, sf)).withColumns({c: r6(F.col(c)) for c in ("truncation_rate", "eos_rate", "token_limit_rate", "mean")})


_ANSWERS = "SELECT doc_id AS id, text || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'Final answer: ' || CAST(doc_id AS {s}) WHEN 2 THEN chr(10) || 'final answer: 7' || chr(10) || 'And more. And more.' ELSE ' It is. It is. It is. It is.' END AS response, CASE WHEN doc_id % 3 = 0 THEN 'token_limit' ELSE 'eos_token' END AS stop_reason, doc_id % 3 = 0 AS token_limit_reached, CASE WHEN doc_id % 4 = 0 THEN 'error' ELSE 'ok' END AS parsing_status, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 = 1 END AS stop_detected, {ids} AS token_ids, doc_id % 2 = 0 AS correct FROM {docs} WHERE text IS NOT NULL"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_LINE = "(?i)(?:^|\\n)Final answer:\\s*([-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\\.[0-9]+)?)"
_REP = "CASE WHEN len({0}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct({0}))::DOUBLE / len({0}) END"
_IDS_SQL = "list_transform(range(doc_id % 7), lambda i: i * doc_id % 3)"


@query(f"""SELECT id, stop_reason = 'eos_token' AS eos_reached, token_limit_reached AS truncated, parsing_status <> 'ok' AS parse_failure, len(marks) > 0 AS answer_marker_present, CASE WHEN len(marks) > 0 THEN (length(response) - length(after) - length(list_last(marks)))::INT END AS answer_marker_character_position, round(CASE WHEN len(marks) > 0 THEN (length(response) - length(after) - length(list_last(marks))) / greatest(1, length(response)) END, 6) AS answer_marker_relative_position,
coalesce(stop_detected, FALSE) AS final_answer_stop_detected, len(token_ids)::INT AS generated_token_count, length(response)::INT AS response_character_count, round({_REP.format('token_ids')}, 6) AS repetition_rate, round({_REP.format('g')}, 6) AS repeated_ngram_rate, round({_REP.format('s')}, 6) AS repeated_sentence_rate, greatest({_REP.format('g')}, {_REP.format('s')}) > 0.5 AS repetitive_loop, correct AS exact_answer_correct,
correct AND len(marks) > 0 AND regexp_replace(after, '\\s+', '', 'g') <> '' AS correct_final_answer_before_continued_generation
FROM (SELECT *, list_last(regexp_split_to_array(response, '{_LINE}')) AS after, regexp_extract_all(response, '{_LINE}') AS marks, CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) ELSE [] END AS g,
list_filter(list_transform(regexp_split_to_array(regexp_replace(response, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+'), lambda s: array_to_string({_WORDS.format('s')}, ' ')), lambda s: s <> '') AS s
FROM (SELECT *, {_WORDS.format('response')} AS w FROM ({_ANSWERS.format(s='VARCHAR', docs='documents', ids=_IDS_SQL)})))""")
def response_diagnostics(spark, sf):
    """Sixteen fields of each response; what a collection records beside the text is a stand-in made of ids."""
    ids = "CASE WHEN doc_id % 7 = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0L, doc_id % 7 - 1), i -> i * doc_id % 3) END"
    rows = spark.sql(_ANSWERS.format(s="STRING", docs="{docs}", ids=ids), docs=read(spark, sf, "documents"))
    x = G.response_diagnostics(rows)
    return x.withColumns({c: r6(F.col(c)) for c in ("answer_marker_relative_position", "repetition_rate", "repeated_ngram_rate", "repeated_sentence_rate")})


@query(f"SELECT id, sha256({norm_sql('response')}) AS question_hash, substr(sha256({norm_sql('response')}), 1, 16) AS source_id FROM ({_RECORDS})")
def question_hashes(spark, sf):
    h = F.sha2(T.normalised(F.col("response")), 256)
    return records(spark, sf).select("id", h.alias("question_hash"), F.substring(h, 1, 16).alias("source_id"))
