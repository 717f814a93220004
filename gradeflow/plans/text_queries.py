"""Registered queries on text: grading, matching, numbers, repetition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.ship import ship_package

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


def norm_sql(x: str) -> str:
    return f"array_to_string({words_sql(x)}, ' ')"


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS digest, len({words_sql('text')})::INT AS n FROM documents")
def normalised_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.normalised(F.col("text"))).alias("digest"), F.size(T.words(F.col("text"))).alias("n"))


#: The tables hold no characters that the compatibility form would change more than the canonical one.
@query(f"SELECT doc_id, md5({norm_sql('nfc_normalize(text)')}) AS digest FROM documents")
def nfkc_normalised(spark, sf):
    ship_package(spark)
    return read(spark, sf, "documents").select("doc_id", F.md5(T.normalised(T.nfkc(F.col("text")))).alias("digest"))


_PAIRS = f"""SELECT c.conv_id, c.turn, {words_sql('c.text')} AS a, {words_sql('d.text')} AS b FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1"""


def _turns(spark, sf):
    c = read(spark, sf, "conversations")
    d = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(d, ["conv_id", "turn"])


@query(f"""WITH p AS ({_PAIRS}), k AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS k FROM p)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(k, 0) / (len(a) + len(b)) END, 6) AS f1 FROM k""")
def token_f1(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(T.token_f1(T.words(F.col("text")), T.words(F.col("next"))), 6).alias("f1"))


@query(f"""WITH n AS (SELECT lower(n_name) AS alias FROM nation UNION ALL SELECT unnest(['the mit license', 'gnu general public license', 'apache license'])),
d AS (SELECT doc_id, {norm_sql('text')} AS t FROM documents), x AS (SELECT {norm_sql('alias')} AS a FROM n)
SELECT doc_id, count(*) AS aliases, max(length(a)) AS longest FROM d JOIN x ON contains(t, a) GROUP BY doc_id""")
def alias_containment(spark, sf):
    """Aliases that stand in a text; the alias list is a constant and one array."""
    names = read(spark, sf, "nation").select(F.lower("n_name").alias("alias")).unionByName(spark.createDataFrame([("the mit license",), ("gnu general public license",), ("apache license",)], "alias string"))
    listed = names.select(T.normalised(F.col("alias")).alias("a")).agg(F.collect_list("a").alias("aliases"))  # 28 names
    docs = read(spark, sf, "documents").select("doc_id", T.normalised(F.col("text")).alias("t")).join(F.broadcast(listed))
    found = docs.select("doc_id", F.filter("aliases", lambda a: F.contains("t", a)).alias("f")).filter("size(f) > 0")
    return found.select("doc_id", F.size("f").cast("long").alias("aliases"), F.array_max(F.transform("f", F.length)).cast("long").alias("longest"))


@query(f"""SELECT conv_id, turn, CASE WHEN a = b THEN 'exact' WHEN b <> '' AND contains(a, b) THEN 'response_contains' WHEN a <> '' AND contains(b, a) THEN 'alias_contains' ELSE 'none' END AS containment
FROM (SELECT c.conv_id, c.turn, {norm_sql('c.text')} AS a, {norm_sql('d.text')} AS b FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1)""")
def containment_diagnostic(spark, sf):
    t = _turns(spark, sf).select("conv_id", "turn", T.normalised(F.col("text")).alias("a"), T.normalised(F.col("next")).alias("b"))
    kind = F.when(F.col("a") == F.col("b"), "exact").when((F.col("b") != "") & F.contains("a", "b"), "response_contains").when((F.col("a") != "") & F.contains("b", "a"), "alias_contains").otherwise("none")
    return t.select("conv_id", "turn", kind.alias("containment"))


@query(f"""WITH x AS (SELECT p_partkey, p_name, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (new)' WHEN 1 THEN '!' WHEN 2 THEN ' x' ELSE '' END AS response FROM part), y AS (SELECT p_partkey,
CASE p_partkey % 3 WHEN 0 THEN 'it is ' ELSE '' END || response AS r, p_name AS a FROM x),
z AS (SELECT p_partkey, {norm_sql('r')} AS nr, {norm_sql('a')} AS na, {norm_sql("trim(regexp_replace(regexp_replace(r, '\\([^()]*\\)', ' ', 'g'), ' +', ' ', 'g'))")} AS np, len({words_sql('r')}) - len({words_sql('a')}) AS e FROM y)
SELECT coalesce(CASE WHEN nr = na THEN 'normalized_exact' WHEN np = na THEN 'response_parenthetical' WHEN na <> '' AND suffix(nr, na) AND e <= 8 THEN 'concise_containment' END, 'no') AS rule, count(*) AS n FROM z GROUP BY 1""")
def concise_rule(spark, sf):
    p = F.col("p_partkey") % 4
    response = F.concat(F.when(F.col("p_partkey") % 3 == 0, "it is ").otherwise(""), F.col("p_name"), F.when(p == 0, " (new)").when(p == 1, "!").when(p == 2, " x").otherwise(""))
    return read(spark, sf, "part").select(F.coalesce(T.concise_rule(response, F.col("p_name")), F.lit("no")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '{T.SEGMENT_BREAK}'), lambda s: regexp_replace(regexp_replace(s, '{T.LIST_MARK}', ''), '^[ \\t,]+|[ \\t,]+$', '', 'g')), lambda s: s <> ''))::INT AS segments FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')""")
def response_segments(spark, sf):
    return read(spark, sf, "documents").filter(F.col("text").rlike(r"[\p{L}\p{N}]")).select("doc_id", F.size(T.segments(F.col("text"))).alias("segments"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'The final answer is: ' || o_custkey || '.' WHEN 1 THEN o_custkey || '/3' WHEN 2 THEN '' WHEN 3 THEN o_custkey || ' and ' || o_orderkey WHEN 4 THEN 'unknown' WHEN 5 THEN '+' || o_custkey || '.00' ELSE o_custkey || '.5' END AS t FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 5) THEN o_custkey::VARCHAR END AS value, CASE o_orderkey % 7 WHEN 1 THEN 'fraction_not_allowed' WHEN 2 THEN 'empty_or_nonnumeric_response' WHEN 3 THEN 'ambiguous_multiple_numbers' WHEN 4 THEN 'no_numeric_answer' WHEN 6 THEN 'non_integer_answer' END AS reason FROM orders""")
def number_parse(spark, sf):
    k, c = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    t = (
        F.when(k == 0, F.concat(F.lit("The final answer is: "), c, F.lit(".")))
        .when(k == 1, F.concat(c, F.lit("/3")))
        .when(k == 2, "")
        .when(k == 3, F.concat(c, F.lit(" and "), F.col("o_orderkey").cast("string")))
        .when(k == 4, "unknown")
        .when(k == 5, F.concat(F.lit("+"), c, F.lit(".00")))
        .otherwise(F.concat(c, F.lit(".5")))
    )
    rows = read(spark, sf, "orders").select("o_orderkey", T.integer_answer(t).alias("x"))
    return rows.select("o_orderkey", "x.value", "x.reason")


@query("SELECT o_orderkey, o_custkey::VARCHAR AS value FROM orders")
def final_number(spark, sf):
    c = F.col("o_custkey").cast("string")
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("12 then \\boxed{"), c, F.lit("} and 4"))).otherwise(F.concat(F.lit("so 7 + 9\n#### "), c))
    return read(spark, sf, "orders").select("o_orderkey", T.final_number(t)["value"].alias("value"))


_ABSTAINED = " OR ".join("regexp_matches(t, '" + pattern.replace("'", "''") + "')" for pattern in T.ABSTENTIONS)


@query(f"""SELECT role, count(*) AS n, count(*) FILTER (WHERE t IN ('', 'unanswerable') OR {_ABSTAINED}) AS abstained
FROM (SELECT role, {norm_sql('text')} AS t FROM (SELECT role, text || CASE conv_id % 5 WHEN 0 THEN ' It is not stated' WHEN 1 THEN ' The context does not say' ELSE '' END AS text FROM conversations)) GROUP BY role""")
def abstentions(spark, sf):
    k = F.col("conv_id") % 5
    c = read(spark, sf, "conversations").select("role", F.concat("text", F.when(k == 0, " It is not stated").when(k == 1, " The context does not say").otherwise("")).alias("text"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(T.abstention(F.col("text")).isNotNull()).alias("abstained"))


@query("""SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct(w))::DOUBLE / len(w) END, 6) AS rate, round(CASE WHEN len(w) < 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct(g))::DOUBLE / len(g) END, 6) AS rate4
FROM (SELECT doc_id, w, list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL))""")
def repetition_rates(spark, sf):
    w = read(spark, sf, "documents").filter("text is not null").select("doc_id", T.tokens(F.col("text")).alias("w"))
    w = w.select("doc_id", "w", T.ngrams(F.col("w"), 4).alias("g"))  # columns of their own, made once
    return w.select("doc_id", F.round(T.repetition(F.col("w")), 6).alias("rate"), F.round(T.repetition(F.col("g")), 6).alias("rate4"))


_SENT = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+'), lambda s: array_to_string(regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+'), ' ')), lambda s: s <> '')"


@query(f"SELECT doc_id, round(CASE WHEN len(s) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct(s))::DOUBLE / len(s) END, 6) AS rate, (len(s) > 1 AND 1.0 - len(list_distinct(s)) / len(s) > 0.5) AS looping FROM (SELECT doc_id, {_SENT} AS s FROM documents WHERE text IS NOT NULL)")
def sentence_repetition(spark, sf):
    s = read(spark, sf, "documents").filter("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    rate = T.repetition(F.col("s"))
    return s.select("doc_id", F.round(rate, 6).alias("rate"), ((F.size("s") > 1) & (rate > 0.5)).alias("looping"))


@query("SELECT doc_id, (strpos(text, 'License') - 1)::INT AS place, round((strpos(text, 'License') - 1) / greatest(1, length(text)), 6) AS relative, length(text)::INT AS n_chars FROM documents WHERE contains(text, 'License')")
def marker_position(spark, sf):
    at = F.instr("text", "License") - 1
    return read(spark, sf, "documents").filter(F.contains("text", F.lit("License"))).select("doc_id", at.alias("place"), F.round(at / F.greatest(F.lit(1), F.length("text")), 6).alias("relative"), F.length("text").alias("n_chars"))


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment AS alias FROM customer), s AS (SELECT alias FROM a GROUP BY alias HAVING count(DISTINCT id) > 1)
SELECT alias, count(*) AS owners FROM a JOIN s USING (alias) GROUP BY alias""")
def shared_aliases(spark, sf):
    owned = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("alias")).agg(F.countDistinct("c_custkey").alias("k"), F.count("*").alias("owners"))
    return owned.filter("k > 1").select("alias", "owners")


@query("SELECT regexp_replace(source || ':' || lang || ':' || doc_id, ':', '__', 'g') AS file, sha256('Context: ' || lang || ' Question: ' || source) AS prompt FROM documents")
def prompts_and_names(spark, sf):
    name = F.replace(F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string")), F.lit(":"), F.lit("__"))
    prompt = F.replace(F.replace(F.lit("Context: {c} Question: {q}"), F.lit("{c}"), F.col("lang")), F.lit("{q}"), F.col("source"))
    return read(spark, sf, "documents").select(name.alias("file"), F.sha2(prompt, 256).alias("prompt"))


@query("""SELECT a.conv_id, count(*) AS interpretations, sum(CASE WHEN m THEN 1 ELSE 0 END)::BIGINT AS covered, round(avg(CASE WHEN m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage FROM (
SELECT c.conv_id, c.turn, bool_or(contains(lower(d.text), lower(regexp_extract(c.text, '[A-Za-z]+')))) AS m FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.role = 'assistant' WHERE c.role = 'user' GROUP BY ALL) a GROUP BY a.conv_id""")
def interpretation_coverage(spark, sf):
    """Share of a conversation's questions of which the first word stands in an answer."""
    c = read(spark, sf, "conversations")
    answers = c.filter("role = 'assistant'").select("conv_id", F.lower("text").alias("answer"))
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("w"))
    met = asked.join(answers, "conv_id").groupBy("conv_id", "turn").agg(F.bool_or(F.contains("answer", "w")).alias("m"))
    hit = F.when(F.col("m"), 1).otherwise(0)
    return met.groupBy("conv_id").agg(F.count("*").alias("interpretations"), F.sum(hit).alias("covered"), F.round(F.avg(hit.cast("double")), 6).alias("coverage"))


@query("""SELECT l.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN 'unresolved' WHEN l.quality = 1 AND l.toxic = 0 THEN 'correct' WHEN l.quality = 1 THEN 'partial' ELSE 'incorrect' END AS label, (l.quality = 0)::INT AS strict_error, (l.quality = 0 OR l.toxic = 1)::INT AS any_error FROM labels l JOIN documents d USING (doc_id)""")
def label_variants(spark, sf):
    x = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    label = F.when(F.coalesce("text", F.lit("")) == "", "unresolved").when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "partial").otherwise("incorrect")
    return x.select("doc_id", label.alias("label"), (F.col("quality") == 0).cast("int").alias("strict_error"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("any_error"))
