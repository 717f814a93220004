"""Registered queries on gates, samples, loaders, orders and set tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates, integrity, sampling
from ..sources import loaders
from .grading_queries import _RECORDS, records
from .table_queries import quota_sql
from .text_queries import norm_sql, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_D = "SELECT d.doc_id, lang, source, n_chars, text, quality, toxic, 1 - quality AS err FROM documents d LEFT JOIN labels l USING (doc_id)"


def labelled(spark, sf, *more):
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", *more)
    return d.join(read(spark, sf, "labels"), "doc_id", "left").withColumn("err", 1 - F.col("quality"))


def r6(x):
    return F.round(x, 6)


@query(f"SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE err IS NULL) / count(*), 6) AS unresolved_rate, count(*) FILTER (WHERE err = 1) AS wrong, count(*) FILTER (WHERE err = 0) AS \"right\", count(*) = 300 AND count(*) FILTER (WHERE err IS NULL) / count(*) <= 0.05 AND count(*) FILTER (WHERE err = 1) >= 20 AND count(*) FILTER (WHERE err = 0) >= 20 AS passed FROM ({_D}) GROUP BY lang")
def label_gate(spark, sf):
    return gates.label_gate(labelled(spark, sf), ["lang"], "err", 300).withColumn("unresolved_rate", r6(F.col("unresolved_rate")))


_G3 = f"SELECT source, count(*) AS n, avg((n_chars > 8000)::INT) AS t, avg((toxic = 1)::INT) AS p, avg((text = '')::INT) AS l, avg(quality) AS a FROM ({_D}) WHERE quality IS NOT NULL GROUP BY source"


@query(f"SELECT source, n, round(t, 6) AS truncation, round(p, 6) AS parse_failure, round(l, 6) AS loop_rate, round(a, 6) AS accuracy, CASE WHEN a > 0 AND a < 1 THEN ceil(greatest(100 / a, 100 / (1 - a)))::BIGINT END AS projected, n = 100 AND t <= 0.05 AND p <= 0.05 AND l <= 0.05 AND a >= 0.05 AND a < 1 AS passed FROM ({_G3})")
def response_gate(spark, sf):
    x = labelled(spark, sf, "text").filter("quality is not null")
    out = gates.response_gate(x, ["source"], F.col("n_chars") > 8000, F.col("toxic") == 1, F.col("text") == "", F.col("quality") == 1)
    return out.withColumns({c: r6(F.col(c)) for c in ("truncation", "parse_failure", "loop_rate", "accuracy")})


_G4 = f"SELECT source, count(*) AS n, avg((n_chars > 8000)::INT) AS t, avg((toxic = 1)::INT) AS p, avg(quality) AS a, bool_and(n_chars > 0) AS v FROM ({_D}) WHERE quality IS NOT NULL GROUP BY source"


@query(f"""SELECT source, n, round(a, 6) AS accuracy, proj AS projected, CASE WHEN r = '' THEN 'passed' ELSE r END AS reasons FROM (SELECT *, concat_ws(',', CASE WHEN n <> 100 THEN 'record_count_mismatch' END, CASE WHEN t > 0.05 THEN 'truncation_above_5_percent' END,
CASE WHEN p > 0.05 THEN 'parsing_failure_above_5_percent' END, CASE WHEN NOT v THEN 'artifact_verification_failure' END, CASE WHEN a IN (0, 1) THEN 'one_class_calibration' WHEN proj > 800 THEN 'projected_minority_below_100' END) AS r
FROM (SELECT *, CASE WHEN a > 0 AND a < 1 THEN ceil(greatest(100 / a, 100 / (1 - a)) - 1e-12)::BIGINT END AS proj FROM ({_G4})))""")
def model_gate(spark, sf):
    x = labelled(spark, sf).filter("quality is not null")
    out = gates.model_gate(x, ["source"], F.col("n_chars") > 8000, F.when(F.col("toxic") == 1, "error").otherwise("ok"), F.col("quality") == 1, F.col("n_chars") > 0, F.lit(800))
    return out.withColumn("accuracy", r6(F.col("accuracy")))


@query(f"SELECT count(*) AS n, round(avg((n_chars > 8000)::INT), 6) AS truncation, count(*) FILTER (WHERE toxic IS DISTINCT FROM 0) AS parse_failures, count(*) = 100 AND avg((n_chars > 8000)::INT) <= 0.05 AND count(*) FILTER (WHERE toxic IS DISTINCT FROM 0) = 0 AS passed FROM (SELECT * FROM ({_D}) ORDER BY doc_id LIMIT 100)")
def first_hundred_gate(spark, sf):
    status = F.when(F.col("toxic") == 0, "ok")
    return gates.first_gate(labelled(spark, sf), "doc_id", F.col("n_chars") > 8000, status).withColumn("truncation", r6(F.col("truncation")))


@query("SELECT 'v4' AS version, TRUE AS passed, TRUE AS other_refused")
def required_gate(spark, sf):
    """A passed gate of the right version lets a run start; another version doesn't."""
    gate = read(spark, sf, "region").agg((F.count("*") > 0).alias("passed")).withColumn("version", F.lit("v4"))
    try:
        gates.require(gate, "v5")
        refused = False
    except PermissionError:
        refused = True
    return gates.require(gate, "v4").select("version", "passed", F.lit(refused).alias("other_refused"))


_PHI = "(SELECT 0.5::DOUBLE + {z} / 3000.0 * sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-({z} * i / 1000.0) * ({z} * i / 1000.0) / 2)) / sqrt(2 * pi()) FROM range(1001) q(i))"


_GAINS = "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, avg(l_tax) - 0.04 AS gain, 1.96 * stddev_samp(l_tax) / sqrt(count(*)) AS half FROM {t} GROUP BY l_returnflag, l_linestatus"


@query(f"""SELECT flag, status, round(power, 6) AS power, gain - half <= 0 AND gain + half >= 0 AND power >= 0.8 AS passed
FROM (SELECT *, {_PHI.format(z='(z - 1.96::DOUBLE)')} + {_PHI.format(z='(-z - 1.96::DOUBLE)')} AS power FROM (SELECT *, abs(gain) / (half / 1.96::DOUBLE * sqrt(1 / 8.0::DOUBLE)) AS z FROM ({_GAINS.format(t='lineitem')})))""")
def power_gates(spark, sf):
    """For each group of items, whose mean tax differs from 0.04 by a gain with an interval: the chance to find it in eight times the rows, and whether that is reason enough to collect them."""
    x = spark.sql(_GAINS.format(t="{items}"), items=read(spark, sf, "lineitem"))
    of = (F.col("gain"), F.col("gain") - F.col("half"), F.col("gain") + F.col("half"), F.col("n"), 8 * F.col("n"))
    return x.select("flag", "status", r6(gates.power(*of)).alias("power"), gates.power_gate(*of).alias("passed"))


@query(f"SELECT dataset, NOT waits AND n >= 30 AS authorised, CASE WHEN waits THEN 'evaluator_validation_pending' WHEN n < 30 THEN 'technical_or_class_balance' END AS reason FROM (SELECT dataset, dataset = 'ambignq' AS waits, count(*) AS n FROM ({_RECORDS}) WHERE id % 13 <> 5 OR dataset <> 'squad' GROUP BY dataset)")
def authorisations(spark, sf):
    by = records(spark, sf).filter("id % 13 <> 5 or dataset <> 'squad'").groupBy("dataset").agg(F.count("*").alias("n"))
    ok, why = gates.authorised(F.col("dataset"), F.col("n") >= 30)
    return by.select("dataset", ok.alias("authorised"), why.alias("reason"))


@query("""WITH f AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderkey % 17 <> 3 AS ok FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT -1 - o_orderkey, 0, TRUE FROM orders WHERE o_orderkey < 5 UNION ALL SELECT o_orderkey, o_totalprice, TRUE FROM orders WHERE o_orderkey % 101 = 1),
p AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS c, count(*) FILTER (WHERE v > 400000 AND k % 2 = 0) AS w FROM f GROUP BY k), b AS (SELECT o.o_orderkey AS e, p.* FROM (SELECT DISTINCT o_orderkey FROM orders) o FULL JOIN p ON o.o_orderkey = p.k)
SELECT count(e) AS expected, count(*) FILTER (WHERE n = 1 AND e IS NOT NULL AND c = 0 AND w = 0) AS valid, count(*) FILTER (WHERE k IS NULL) AS missing, count(*) FILTER (WHERE e IS NULL) AS unexpected, sum(n - 1)::BIGINT AS duplicates, sum(c)::BIGINT AS changed, sum(w)::BIGINT AS nonfinite, FALSE AS passed FROM b""")
def verified_collection(spark, sf):
    """A collection with gaps, strangers, doubles, changed records and numbers that aren't finite."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    v = F.when((F.col("o_totalprice") > 400000) & (F.col("o_orderkey") % 2 == 0), float("nan")).otherwise(F.col("o_totalprice"))
    found = o.filter("o_orderkey % 11 <> 0").withColumn("ok", F.col("o_orderkey") % 17 != 3)
    found = found.unionByName(o.filter("o_orderkey < 5").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), F.lit(True).alias("ok"))).unionByName(o.filter("o_orderkey % 101 = 1").withColumn("ok", F.lit(True)))
    return gates.verification(o, found.withColumn("o_totalprice", v), "o_orderkey", F.col("ok"), ["o_totalprice"])


@query("SELECT bool_and(doc_id IS NOT NULL) AS ids, bool_and(coalesce(length(text), 0) = n_chars) AS lengths, bool_and(lang IN ('en', 'de', 'fr', 'es')) AS languages, bool_and(n_chars > 0) AS texts, FALSE AS \"never\", FALSE AS passed FROM documents")
def experiment_integrity(spark, sf):
    d = read(spark, sf, "documents")
    return gates.integrity(d, {"ids": F.col("doc_id").isNotNull(), "lengths": F.coalesce(F.length("text"), F.lit(0)) == F.col("n_chars"), "languages": F.col("lang").isin("en", "de", "fr", "es"), "texts": F.col("n_chars") > 0, "never": F.lit(False)})


@query("SELECT n, 0::BIGINT AS double_keys, 0 AS banned_fields, TRUE AS in_order, TRUE AS passed FROM (SELECT count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100)) UNION ALL SELECT 100, 0, 1, TRUE, FALSE UNION ALL SELECT 101, 1, 0, FALSE, FALSE")
def manifest_faults(spark, sf):
    """A good manifest, one with content that it must not hold, and one with a key twice."""
    few = sampling.limited(read(spark, sf, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("at")), "at", "o_orderkey", 100)
    good = few.select("o_orderkey", "selection_order")
    double = good.unionByName(good.filter("selection_order = 7"))
    out = None
    for m in (good, good.withColumn("response", F.lit("x")), double):
        row = gates.manifest_faults(m, "o_orderkey", "selection_order", 100)
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT o_orderkey, row_number() OVER (ORDER BY p, o_orderkey) - 1 AS selection_order FROM (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, 0) AS p FROM orders) ORDER BY p, o_orderkey LIMIT 50")
def calibration_manifest(spark, sf):
    """The first rows by an order that may be missing, numbered again; too few are an error."""
    o = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("at"))
    try:
        sampling.limited(o, "at", "o_orderkey", 1 << 30)
    except ValueError:
        return sampling.limited(o, "at", "o_orderkey", 50).select("o_orderkey", "selection_order")
    raise AssertionError("a short manifest was not refused")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS selection_order FROM documents")
def whole_manifest(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    return sampling.ranked(d, "doc_id", "doc_id").select("doc_id", (F.col("rank") - 1).alias("selection_order"))


@query("SELECT doc_id, n_chars, length(text) - length(replace(text, chr(10), '')) AS n_lines FROM documents ORDER BY n_chars DESC, n_lines DESC, doc_id LIMIT 10")
def longest_by_two(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))
    return d.orderBy(F.desc_nulls_last("n_chars"), F.desc_nulls_last("n_lines"), "doc_id").limit(10)


@query("(SELECT 'low' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) UNION ALL (SELECT 'high', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)")
def extremes(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    low, high = o.orderBy("o_totalprice", "o_orderkey").limit(5), o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))


@query(f"""WITH d AS ({_D}), a AS (SELECT min(doc_id) AS k FROM d WHERE quality = 0), b AS (SELECT min(doc_id) AS k FROM d WHERE toxic = 1 AND doc_id NOT IN (SELECT k FROM a)), c AS (SELECT min(doc_id) AS k FROM d WHERE quality = 0 AND doc_id NOT IN (SELECT k FROM a) AND doc_id NOT IN (SELECT k FROM b))
SELECT 'wrong' AS selector, k AS doc_id FROM a UNION ALL SELECT 'toxic', k FROM b UNION ALL SELECT 'wrong again', k FROM c""")
def selected_examples(spark, sf):
    return sampling.first_by_selector(labelled(spark, sf), "doc_id", [("wrong", F.col("quality") == 0), ("toxic", F.col("toxic") == 1), ("wrong again", F.col("quality") == 0)])


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_of_each_source(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT p_partkey, string_agg(x, ',' ORDER BY sha256(seed || ':' || x), x) AS shuffled FROM (SELECT p_partkey, ('0x' || substr(sha256(p_partkey::VARCHAR), 1, 16))::UBIGINT::VARCHAR AS seed, unnest([p_brand, p_type, 'size ' || p_size]) AS x FROM part) GROUP BY p_partkey""")
def seeded_options(spark, sf):
    """Options in the order of a digest with a seed of 64 bits that the id's own digest gives."""
    x = F.array("p_brand", "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return read(spark, sf, "part").select("p_partkey", F.concat_ws(",", integrity.seeded_order(F.col("p_partkey").cast("string"), x)).alias("shuffled"))


@query("""WITH o AS (SELECT p_partkey, i, x, i <= 2 AS correct, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256(seed || ':' || x), x) - 1 AS place FROM (SELECT p_partkey, ('0x' || substr(sha256(p_partkey::VARCHAR), 1, 16))::UBIGINT::VARCHAR AS seed, unnest([p_name, 'the ' || p_name, p_brand, p_type]) AS x, unnest([1, 2, 3, 4]) AS i FROM part))
SELECT p_partkey, count(*) AS options, string_agg(place::VARCHAR, ',' ORDER BY place) FILTER (WHERE correct) AS correct_places FROM o GROUP BY p_partkey""")
def choice_manifest(spark, sf):
    """Correct and incorrect options as one list in seeded order, and where the correct ones stand."""
    p = read(spark, sf, "part").select("p_partkey", F.array("p_name", F.concat(F.lit("the "), "p_name")).alias("good"), F.array("p_brand", "p_type").alias("bad"))
    shuffled = integrity.seeded_order(F.col("p_partkey").cast("string"), F.concat("good", "bad"))
    places = F.filter(F.transform(shuffled, lambda x, i: F.when(F.array_contains("good", x), i)), lambda i: i.isNotNull())
    return p.select("p_partkey", F.size(shuffled).cast("long").alias("options"), F.concat_ws(",", F.transform(places, lambda i: i.cast("string"))).alias("correct_places"))


@query("""WITH o AS (SELECT p_partkey, p_name, x, i <= 2 AS correct, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256(seed || ':' || x), x) - 1 AS place FROM (SELECT p_partkey, p_name, ('0x' || substr(sha256(p_partkey::VARCHAR), 1, 16))::UBIGINT::VARCHAR AS seed, unnest([p_name, 'the ' || p_name, p_brand, p_type]) AS x, unnest([1, 2, 3, 4]) AS i FROM part))
SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS selection_order, 'category:' || p_brand || '|type:' || p_type AS sampling_stratum, options, best AS correct_option_index, places AS correct_option_indices, 'MC1,MC2' AS mc_protocols, digest AS option_order_checksum
FROM part JOIN (SELECT p_partkey, count(*)::INT AS options, min(place) FILTER (WHERE correct AND x = p_name)::INT AS best, string_agg(place::VARCHAR, ',' ORDER BY place) FILTER (WHERE correct) AS places, sha256('["' || string_agg(x, '","' ORDER BY place) || '"]') AS digest FROM o GROUP BY p_partkey) USING (p_partkey)""")
def choice_rows(spark, sf):
    """The manifest of questions with options: where the right ones stand and a digest of the order, but no texts."""
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.array("p_name", F.concat(F.lit("the "), "p_name")).alias("good"), F.array("p_brand", "p_type").alias("bad"))
    stratum = F.concat(F.lit("category:"), "p_brand", F.lit("|type:"), "p_type")
    x = sampling.choice_manifest(p, "p_partkey", "good", "bad", "p_name", stratum)
    return x.select("p_partkey", "selection_order", "sampling_stratum", F.col("option_count").alias("options"), "correct_option_index", F.concat_ws(",", F.transform("correct_option_indices", lambda i: i.cast("string"))).alias("correct_option_indices"), F.concat_ws(",", "mc_protocols").alias("mc_protocols"), "option_order_checksum")


_SIDES = "SELECT {d} AS damaged, count(*) AS predictions, count(*) FILTER (WHERE NOT {d} OR k % 97 <> 5) AS signatures, {d}::INT * count(*) FILTER (WHERE k % 97 = 5) AS without_signature, {d}::INT * count(*) FILTER (WHERE k % 89 = 7) AS other_experiments, {d}::INT * count(*) FILTER (WHERE k % 83 = 2) AS changed_predictions, {d}::INT * count(*) FILTER (WHERE k % 79 = 3) AS changed_prompts, {d}::INT * count(*) FILTER (WHERE k % 73 = 4) AS not_canonical FROM (SELECT c_custkey AS k FROM customer)"


@query(f"""SELECT damaged, predictions, signatures, without_signature::BIGINT AS without_signature, other_experiments::BIGINT AS other_experiments, changed_predictions::BIGINT AS changed_predictions, changed_prompts::BIGINT AS changed_prompts, not_canonical::BIGINT AS not_canonical,
predictions = signatures AND without_signature + other_experiments + changed_predictions + changed_prompts + not_canonical = 0 AS passed FROM ({_SIDES.format(d='FALSE')} UNION ALL {_SIDES.format(d='TRUE')})""")
def collection_checks(spark, sf):
    """A whole collection passes; one with gaps, strangers and changed records doesn't, and the row says why."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("example_id"), F.col("c_name").alias("prompt"))
    k, out = F.col("example_id"), None
    size = c.count() // 5
    whole = c.withColumns({"dataset": F.concat(F.lit("d"), k % 5), "experiment_id": F.lit("one"), "prompt_checksum": F.sha2("prompt", 256), "intact": F.lit(True)})
    for damaged in (False, True):
        hurt = lambda test, bad, good: F.when(test & F.lit(damaged), bad).otherwise(good)  # noqa: E731, B023
        p = whole.withColumns({"experiment_id": hurt(k % 89 == 7, F.lit("other"), F.col("experiment_id")), "intact": hurt(k % 83 == 2, F.lit(False), F.col("intact")), "prompt_checksum": hurt(k % 79 == 3, F.lit("x"), F.col("prompt_checksum"))})
        s = whole.filter(~F.lit(damaged) | (k % 97 != 5))
        row = gates.collection_integrity(p, s, c.filter(~F.lit(damaged) | (k % 73 != 4)), "one", size)
        row = row.select(F.lit(damaged).alias("damaged"), "predictions", "signatures", "without_signature", "other_experiments", "changed_predictions", "changed_prompts", "not_canonical", "passed")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS orders_in_customers, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS customers_in_orders")
def subset_tests(spark, sf):
    o, c = read(spark, sf, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return spark.createDataFrame([(integrity.is_subset(o, c, "k"), integrity.is_subset(c, o, "k"))], "orders_in_customers boolean, customers_in_orders boolean")


@query("SELECT 'documents' AS name, 'text' AS forbidden UNION ALL SELECT 'conversations', 'text' UNION ALL SELECT 'benchmark', 'text'")
def forbidden_fields(spark, sf):
    """Content fields of tables that might be used as manifests."""
    rows = [(name, c) for name in ("documents", "labels", "conversations", "benchmark", "orders") for c in integrity.forbidden(read(spark, sf, name), gates.BANNED)]
    return spark.createDataFrame(rows, "name string, forbidden string")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'fixed' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders")
def overlaid_records(spark, sf):
    """Fields of a correction replace those of the record of the same id."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return integrity.overlay(o, o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("fixed").alias("o_orderstatus")), "o_orderkey")


@query("SELECT o_orderkey, source_hash FROM (SELECT o_orderkey, sha256('{\"o_custkey\": ' || o_custkey || ', \"o_orderkey\": ' || o_orderkey || '}' || chr(10)) AS source_hash FROM orders)")
def manifest_digests(spark, sf):
    """A manifest joined to its records by id, digests compared; a record that changed is an error."""
    from ..functions.canonical import record_digest

    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    manifest = o.select("o_orderkey", record_digest(o).alias("source_hash"))
    return integrity.matched_by_digest(manifest, o, "o_orderkey", "source_hash").select("o_orderkey", "source_hash")


# loaders

_RAW = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'Who ordered ' || o_orderkey || '?' END AS question, CASE WHEN o_orderkey % 7 = 0 THEN ' ; ' ELSE ' Customer ' || o_custkey || '; ;c' || o_custkey END AS answers FROM {orders}"


@query(f"""WITH r AS ({_RAW.replace('{orders}', 'orders')}), p AS (SELECT *, list_distinct(list_filter(list_transform(string_split(answers, ';'), lambda x: trim(x)), lambda x: x <> '')) AS al FROM r)
SELECT 'nq:' || id AS example_id, 'nq:' || substr(sha256({norm_sql('question')}), 1, 16) AS source_id, trim(question) AS question, len(al)::INT AS aliases, CASE WHEN trim(question) = '' THEN 'blank_question' WHEN len(al) = 0 THEN 'no_answers' END AS fault FROM p""")
def loaded_questions(spark, sf):
    raw = spark.sql(_RAW, orders=read(spark, sf, "orders"))
    x = loaders.with_aliases(raw, "nq", "id", "question", loaders.listed(F.col("answers")))
    return x.select("example_id", "source_id", "question", F.size("aliases").alias("aliases"), "fault")


@query("""SELECT 'squad:' || doc_id AS example_id, doc_id % 3 > 0 AS answerable, CASE WHEN coalesce(trim(text), '') = '' THEN 'no_context' WHEN doc_id % 3 > 0 AND (length(text) < 3 OR doc_id % 3 = 2 AND substr(text, 4, length(substr(text, 3, 5))) <> substr(text, 3, 5)) THEN 'span_not_in_context' END AS fault FROM documents""")
def loaded_spans(spark, sf):
    """Answers that must stand in their context where they say; every third has none, every third a wrong place."""
    k = F.col("doc_id") % 3
    raw = read(spark, sf, "documents").select("doc_id", F.lit("What?").alias("q"), "text", F.when(k == 2, 3).otherwise(2).alias("start"), F.when(k > 0, F.substring("text", 3, 5)).alias("answer"))
    return loaders.with_spans(raw, "doc_id", "q", "text", "start", "answer").select("example_id", "answerable", "fault")


_NOTED = """SELECT CAST(p_partkey AS {s}) AS id, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE 'Which ' || p_type || '?' END AS question, p_name AS name, p_brand AS brand, p_partkey % 5 AS k FROM {t}"""


@query(f"""SELECT 'ambignq:train:' || id AS example_id, k IN (1, 2) AS is_ambiguous, CASE WHEN k IN (1, 2) THEN 2 ELSE 1 END AS n_interpretations, CASE k WHEN 0 THEN name WHEN 1 THEN name || '|' || brand WHEN 2 THEN name ELSE '' END AS aliases,
CASE WHEN trim(question) = '' THEN 'blank_question' WHEN k = 4 THEN 'unknown_annotation' WHEN k = 2 THEN 'interpretation_without_answers' WHEN k = 3 THEN 'no_answers' END AS fault FROM ({_NOTED.format(s='VARCHAR', t='part')})""")
def loaded_ambiguous(spark, sf):
    """Questions with one answer or several interpretations, read from lines of JSON; faults apart."""
    from ..sources import records as R
    from ..sources.shared import shared_folder

    raw = spark.sql(_NOTED.format(s="STRING", t="{part}"), part=read(spark, sf, "part"))
    pair = lambda q, answers: F.struct(F.lit(q).alias("question"), answers.alias("answer"))
    none = F.array().cast("array<string>")
    pairs = F.array(pair("one", F.array("name", F.lit(" "))), pair("two", F.when(F.col("k") == 1, F.array("brand", "name")).otherwise(F.array(F.lit("")))))
    kind = F.when(F.col("k") == 4, "other").when(F.col("k").isin(1, 2), loaders.SEVERAL).otherwise(loaders.SINGLE)
    note = F.struct(kind.alias("type"), F.when(F.col("k") == 0, F.array("name", F.lit(""))).otherwise(none).alias("answer"), F.when(F.col("k").isin(1, 2), pairs).alias("qaPairs"))
    at = shared_folder(spark, "ambiguous") + "/rows"
    R.write_once(raw.select("id", "question", F.array(note).alias("annotations")), at)
    x = loaders.ambiguous(R.read_lines(spark, at, loaders.AMBIGUOUS), "train")
    return x.select("example_id", "is_ambiguous", "n_interpretations", F.concat_ws("|", "aliases").alias("aliases"), "fault")


_TOLD = "SELECT 'Is ' || p_name || ' ' || CAST(p_partkey AS {s}) || '?' AS question, p_brand AS best, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type || '; ' || p_brand END AS others, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'no; never' END AS wrong, p_partkey % 13 = 0 AS short FROM {t}"


@query(f"""SELECT question, CASE WHEN NOT short THEN CASE WHEN others = '' THEN best ELSE best || '|' || string_split(others, ';')[1] END END AS aliases, CASE WHEN NOT short THEN CASE WHEN wrong = '' THEN '' ELSE 'no|never' END END AS wrong_aliases, CASE WHEN short THEN 'malformed_line' WHEN wrong = '' THEN 'no_wrong_answers' END AS fault
FROM (SELECT CASE WHEN short THEN NULL ELSE question END AS question, best, others, wrong, short FROM ({_TOLD.format(s='VARCHAR', t='part')}))""")
def loaded_truthful(spark, sf):
    """A CSV file of questions with right and wrong answers; lines with too few fields are kept apart as they stand."""
    from ..sources.shared import shared_folder

    raw = spark.sql(_TOLD.format(s="STRING", t="{part}"), part=read(spark, sf, "part"))
    cell = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    whole = F.concat_ws(",", F.lit("Adversarial"), F.lit("Test"), cell("question"), cell("best"), F.lit(""), cell("others"), cell("wrong"), F.lit("made"))
    at = shared_folder(spark, "truthful")
    line = raw.select(F.when(F.col("short"), F.lit("broken,line")).otherwise(whole).alias("value"))
    line.write.text(at)
    x = loaders.truthful(loaders.read_truthful(spark, at, header=False))
    good = F.col("fault").isNull() | (F.col("fault") != "malformed_line")
    return x.select(F.when(good, F.col("question")).alias("question"), F.when(good, F.concat_ws("|", "aliases")).alias("aliases"), F.when(good, F.concat_ws("|", "wrong_aliases")).alias("wrong_aliases"), "fault")


@query("SELECT 'triviaqa:validation:q' || p_partkey AS example_id, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_name = p_brand THEN p_name ELSE p_name || '|' || p_brand END AS aliases, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'evidence/wikipedia/' || p_type || '.txt' END AS evidence, CASE WHEN p_partkey % 4 = 0 THEN 'answerless' END AS fault FROM part")
def loaded_evidence(spark, sf):
    """Questions with evidence, which is referred to and not an example itself; those without an answer apart."""
    from ..sources import records as R
    from ..sources.shared import shared_folder

    p = read(spark, sf, "part")
    answer = F.struct(F.col("p_name").alias("Value"), F.array("p_name", "p_brand", F.lit("")).alias("Aliases"), F.array(F.lower("p_name")).alias("NormalizedAliases"))
    page = F.array(F.struct(F.concat("p_type", F.lit(".txt")).alias("Filename"), F.col("p_type").alias("Title"), F.lit("TagMe").alias("DocSource")))
    raw = p.select(F.concat(F.lit("q"), "p_partkey").alias("QuestionId"), F.lit("Who?").alias("Question"), F.when(F.col("p_partkey") % 4 != 0, answer).alias("Answer"), F.when(F.col("p_partkey") % 3 != 0, page).alias("EntityPages"))
    at = shared_folder(spark, "evidence") + "/rows"
    R.write_once(raw, at)
    x = loaders.with_evidence(R.read_lines(spark, at, loaders.EVIDENCE), "validation")
    return x.select("example_id", F.concat_ws("|", "aliases").alias("aliases"), F.concat_ws("|", "evidence.path").alias("evidence"), "fault")


_SOLVED = "SELECT o_orderkey AS id, 'How many?' AS question, CASE o_orderkey % 6 WHEN 0 THEN 'so #### 1,0' || lpad(CAST(o_custkey % 100 AS {s}), 2, '0') WHEN 1 THEN '#### ' || CAST(o_custkey AS {s}) || '.0' WHEN 2 THEN '#### 0.25' WHEN 3 THEN '#### NaN' WHEN 4 THEN 'twelve' ELSE '#### +' || CAST(o_custkey AS {s}) END AS solution, CAST(o_custkey AS {s}) AS c FROM {t}"


@query(f"""SELECT 'gsm8k:' || id AS example_id, answer, CASE WHEN answer IS NULL THEN 'no_numeric_answer' END AS fault FROM (SELECT id, CASE id % 6 WHEN 0 THEN '10' || lpad((c::INT % 100)::VARCHAR, 2, '0') WHEN 1 THEN c WHEN 2 THEN '0.25' WHEN 5 THEN c END AS answer FROM ({_SOLVED.format(s='VARCHAR', t='orders')}))""")
def loaded_solutions(spark, sf):
    raw = spark.sql(_SOLVED.format(s="STRING", t="{orders}"), orders=read(spark, sf, "orders"))
    return loaders.with_gold(raw, "id", "question", "solution").select("example_id", "answer", "fault")


_SUMS = "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey AS {s}) || ' ' || CASE l_linenumber % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '*' WHEN 3 THEN '/' ELSE '^' END || ' ' || CAST(l_linenumber AS {s}) AS e, CASE l_linenumber % 5 WHEN 0 THEN l_partkey + l_linenumber WHEN 1 THEN l_partkey - l_linenumber WHEN 2 THEN l_partkey * l_linenumber + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END WHEN 3 THEN CAST(floor(l_partkey / l_linenumber) AS BIGINT) ELSE 0 END AS stored, l_partkey, l_linenumber FROM {t}"


@query(f"""SELECT 'arithmetic:' || id AS example_id, CASE l_linenumber % 5 WHEN 0 THEN l_partkey + l_linenumber WHEN 1 THEN l_partkey - l_linenumber WHEN 2 THEN l_partkey * l_linenumber WHEN 3 THEN CASE WHEN l_partkey % l_linenumber = 0 THEN l_partkey // l_linenumber END END AS value,
CASE l_linenumber % 5 WHEN 4 THEN 'unsupported' WHEN 3 THEN CASE WHEN l_partkey % l_linenumber > 0 THEN 'inexact_division' END WHEN 2 THEN CASE WHEN l_partkey % 10 = 0 THEN 'wrong_stored_answer' END END AS fault FROM ({_SUMS.format(s='VARCHAR', t='lineitem')})""")
def loaded_sums(spark, sf):
    raw = spark.sql(_SUMS.format(s="STRING", t="{lineitem}"), lineitem=read(spark, sf, "lineitem"))
    return loaders.with_expressions(raw, "id", "e", "stored").select("example_id", "value", "fault")


@query(f"""WITH r AS ({_RAW.replace('{orders}', 'orders')}), s AS ({_SOLVED.format(s='VARCHAR', t='orders')}) SELECT 'nq' AS dataset, count(*) AS "rows", count(*) FILTER (WHERE id % 9 <> 0 AND id % 7 <> 0) AS good, count(*) FILTER (WHERE id % 9 = 0 OR id % 7 = 0) AS faults FROM r
UNION ALL SELECT 'gsm8k', count(*), count(*) FILTER (WHERE id % 6 NOT IN (3, 4)), count(*) FILTER (WHERE id % 6 IN (3, 4)) FROM s""")
def prepared_datasets(spark, sf):
    """All enabled datasets, audited without writing."""
    orders = read(spark, sf, "orders")
    raw, solved = spark.sql(_RAW, orders=orders), spark.sql(_SOLVED.format(s="STRING", t="{orders}"), orders=orders)
    return loaders.prepare_all({"nq": loaders.with_aliases(raw, "nq", "id", "question", loaders.listed(F.col("answers"))), "gsm8k": loaders.with_gold(solved, "id", "question", "solution")})


# samples

_CELLS = "SELECT doc_id, 'first:' || (ntile(4) OVER (ORDER BY n_chars, doc_id) - 1) || '|second:' || (ntile(4) OVER (ORDER BY length(source) * 1000 + n_chars % 1000, doc_id) - 1) AS stratum FROM documents WHERE n_chars IS NOT NULL"


@query(f"""WITH c AS ({_CELLS}), q AS ({quota_sql('c', 'stratum', 100)}), p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('x:' || doc_id), doc_id) AS place FROM c) SELECT doc_id, stratum FROM p JOIN q ON stratum = s WHERE place <= quota""")
def crossed_quartile_sample(spark, sf):
    d = read(spark, sf, "documents").filter("n_chars is not null").select("doc_id", "n_chars", (F.length("source") * 1000 + F.col("n_chars") % 1000).alias("other"))
    return sampling.crossed(d, "n_chars", "other", "doc_id", 100, "x").select("doc_id", "stratum")


@query("""WITH u AS (SELECT o_custkey, arg_min(o_orderkey, md5('u:' || o_orderkey)) AS o_orderkey, arg_min(o_orderstatus, md5('u:' || o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey)
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('u:' || o_orderkey), o_orderkey) AS place FROM u) WHERE place <= 20""")
def unique_context_sample(spark, sf):
    """Twenty of each class, no context twice."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return sampling.unique_balanced(o, "o_custkey", "o_orderstatus", "o_orderkey", 20, "u").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT max(n) - min(n) <= 50 AS balanced, count(*) AS cells, min(n) AS low, max(n) AS high FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def cell_balance(spark, sf):
    """Whether the cells of two columns are of like size."""
    return integrity.balance(read(spark, sf, "documents"), ["lang", "source"], 50)


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'clean' WHEN p_partkey % 4 = 1 THEN 'light' WHEN p_partkey % 4 = 2 THEN 'full' END AS variant FROM part")
def dataset_variants(spark, sf):
    """The first variant whose audit is clean, null if none is."""
    k = F.col("p_partkey") % 4
    return read(spark, sf, "part").select("p_partkey", sampling.variant(("clean", k == 0), ("light", k <= 1), ("full", k <= 2)).alias("variant"))


@query("""WITH q AS (SELECT o_orderkey, ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS quartile FROM orders WHERE o_orderkey % 10 <> 0), p AS (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY md5('f:' || o_orderkey), o_orderkey) AS place FROM q)
SELECT o_orderkey, quartile FROM p WHERE place <= 25""")
def gated_sample(spark, sf):
    """A full sample by quartiles that shares no row with the calibration, made only behind a passed gate."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    calibration = o.filter("o_orderkey % 10 = 0")
    gates.require(calibration.agg((F.count("*") > 0).alias("passed")).withColumn("version", F.lit("v4")), "v4")
    rest = o.join(calibration.select("o_orderkey"), "o_orderkey", "left_anti")
    return sampling.per_class(sampling.quartiles(rest, "o_totalprice", "o_orderkey", "quartile"), "quartile", "o_orderkey", 25, "f").select("o_orderkey", F.col("quartile").cast("long").alias("quartile"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS fold FROM labels WHERE quality = 0")
def leave_one_out(spark, sf):
    return sampling.leave_one_out(read(spark, sf, "labels").filter("quality = 0").select("doc_id"), "doc_id").select("doc_id", "fold")


@query("SELECT lang, CASE WHEN m >= 2 THEN least(5, m) END AS folds FROM (SELECT lang, least(sum(quality), count(*) - sum(quality))::BIGINT AS m FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def fold_counts(spark, sf):
    by = labelled(spark, sf).filter("quality is not null").groupBy("lang").agg(F.least(F.sum("quality"), F.count("*") - F.sum("quality")).alias("m"))
    return by.select("lang", sampling.fold_count(F.col("m")).alias("folds"))


@query("""SELECT conv_id, turn, regexp_matches(t, '(?i)(?:^|\\n)Final answer:[^\\n]*[0-9][^\\n]*\\n') AS at_answer, regexp_matches(t, '^\\s*\\S[^\\n]*\\n') OR regexp_matches(t, '(?i)^\\s*unanswerable\\b') AS at_line
FROM (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text || chr(10) || 'Final answer: ' || conv_id || chr(10) WHEN 1 THEN replace(text, chr(10), ' ') WHEN 2 THEN 'UNANSWERABLE' ELSE text END AS t FROM conversations)""")
def stopping_rules(spark, sf):
    """Where a generation would be stopped."""
    k = F.col("conv_id") % 4
    t = F.when(k == 0, F.concat("text", F.lit("\nFinal answer: "), F.col("conv_id").cast("string"), F.lit("\n"))).when(k == 1, F.replace("text", F.lit("\n"), F.lit(" "))).when(k == 2, "UNANSWERABLE").otherwise(F.col("text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", gates.stops_at_answer(F.col("t")).alias("at_answer"), gates.stops_at_line(F.col("t")).alias("at_line"))


@query("SELECT kind, count(*) AS aliases, count(DISTINCT owner) AS owners FROM (SELECT 'type' AS kind, p_type AS alias, p_partkey AS owner FROM part UNION ALL SELECT 'brand', p_brand, p_partkey FROM part) GROUP BY kind")
def concatenated_lists(spark, sf):
    """Two lists of options as one."""
    p = read(spark, sf, "part").select("p_partkey", F.concat(F.array(F.struct(F.lit("type").alias("kind"), F.col("p_type").alias("alias"))), F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("alias")))).alias("x"))
    return p.select("p_partkey", F.explode("x").alias("x")).groupBy("x.kind").agg(F.count("*").alias("aliases"), F.countDistinct("p_partkey").alias("owners"))


@query(f"SELECT count(DISTINCT {norm_sql('text')}) AS questions FROM benchmark")
def distinct_questions(spark, sf):
    return read(spark, sf, "benchmark").agg(F.countDistinct(T.normalised(F.col("text"))).alias("questions"))
