"""Registered queries on tables: filters, joins, set checks, aggregates, samples, folds and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import integrity, overlaps, sampling
from ..streaming import monitor
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


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars < 2000 AND lang IS NOT NULL AND text IS NOT NULL")
def scan_filter_project(spark, sf):
    return read(spark, sf, "documents").filter("n_chars < 2000 AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def label_join(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang", "source").join(read(spark, sf, "labels"), "doc_id")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) AS missing, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 45 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS unexpected, (SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 45) AS duplicates")
def missing_unexpected(spark, sf):
    found = read(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return integrity.missing_and_unexpected(read(spark, sf, "orders").select("o_orderkey"), found, "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def still_to_do(spark, sf):
    done = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(done, "o_orderkey", "left_anti")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AND (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS equal")
def key_sets_equal(spark, sf):
    found = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    out = integrity.missing_and_unexpected(read(spark, sf, "customer"), found, "c_custkey")
    return out.select(((F.col("missing") == 0) & (F.col("unexpected") == 0)).alias("equal"))


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND {norm_sql('text')} NOT IN (SELECT {norm_sql('text')} FROM benchmark)")
def double_anti_join(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", T.normalised(F.col("text")).alias("k"))
    b = read(spark, sf, "benchmark").select(T.normalised(F.col("text")).alias("k"))
    return d.join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").join(b, "k", "left_anti").select("doc_id")


@query("SELECT count(*) - count(DISTINCT l_orderkey) AS duplicates, count(DISTINCT l_orderkey) AS ids FROM lineitem")
def duplicate_ids(spark, sf):
    return read(spark, sf, "lineitem").agg((F.count("*") - F.countDistinct("l_orderkey")).alias("duplicates"), F.countDistinct("l_orderkey").alias("ids"))


@query("SELECT lang, coalesce(quality::VARCHAR, 'None') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def class_balance(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang", F.coalesce(F.col("quality").cast("string"), F.lit("None")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT lang, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5)::DOUBLE AS median, round(stddev_pop(n_chars), 6) AS sd FROM documents GROUP BY lang")
def length_summary(spark, sf):
    n = "n_chars"
    return read(spark, sf, "documents").groupBy("lang").agg(F.min(n).alias("low"), F.max(n).alias("high"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, 0.5).alias("median"), F.round(F.stddev_pop(n), 6).alias("sd"))


@query("SELECT count(*) AS n, sum((text = '')::INT)::BIGINT AS empty, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated_records FROM (SELECT text, count(*) OVER (PARTITION BY text) AS k FROM documents)")
def response_summary(spark, sf):
    by_text = read(spark, sf, "documents").groupBy("text").agg(F.count("*").alias("k"))
    return by_text.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("text") == "", F.col("k")).otherwise(0)).alias("empty"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("repeated_records"))


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text ORDER BY copies DESC, first_id LIMIT 10")
def top_repeated(spark, sf):
    return read(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).orderBy(F.desc("copies"), "first_id").limit(10).select("first_id", "copies")


@query("SELECT source, least(3, n_chars // 1000) AS bucket, count(*) AS n, sum(quality)::BIGINT AS correct, round(avg(quality), 6) AS accuracy, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def subgroup_table(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf, "labels"), "doc_id")
    return d.groupBy("source", F.least(F.lit(3), F.expr("n_chars div 1000")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("quality").alias("correct"), F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("SELECT toxic, round(avg(n_chars) FILTER (WHERE quality = 1), 6) AS mean_ok, quantile_cont(n_chars, 0.5) FILTER (WHERE quality = 0)::DOUBLE AS median_bad FROM documents JOIN labels USING (doc_id) GROUP BY toxic")
def conditional_means(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id")
    return d.groupBy("toxic").agg(F.round(F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))), 6).alias("mean_ok"), F.percentile(F.when(F.col("quality") == 0, F.col("n_chars")), 0.5).alias("median_bad"))


@query("SELECT o_orderkey, ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS quartile FROM orders")
def quartile_strata(spark, sf):
    return sampling.quartiles(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "quartile").select("o_orderkey", F.col("quartile").cast("long").alias("quartile"))


def quota_sql(rows: str, stratum: str, size: int) -> str:
    """Quotas by largest remainder, one at least: (stratum, quota)."""
    return f"""SELECT s, base + CASE WHEN short > 0 AND up <= short AND base < k THEN 1 WHEN short < 0 AND down <= -short AND base > 1 THEN -1 ELSE 0 END AS quota FROM (
SELECT *, want - sum(base) OVER () AS short, row_number() OVER (ORDER BY (base >= k)::INT, rest DESC, s) AS up, row_number() OVER (ORDER BY (base <= 1)::INT, rest, s DESC) AS down FROM (
SELECT s, k, want, least(k, greatest(floor(k * want / n)::BIGINT, 1)) AS base, k * want / n - floor(k * want / n) AS rest FROM (SELECT s, k, sum(k) OVER () AS n, least({size}, sum(k) OVER ()) AS want FROM (SELECT {stratum} AS s, count(*) AS k FROM {rows} GROUP BY 1))))"""


@query(f"""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s:' || c_custkey), c_custkey) AS place FROM customer) SELECT c_custkey, c_mktsegment FROM r JOIN ({quota_sql('customer', 'c_mktsegment', 103)}) ON c_mktsegment = s WHERE place <= quota""")
def proportional_sample(spark, sf):
    return sampling.proportional(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 103, "s").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, quality, place FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('b:' || doc_id), doc_id) AS place FROM labels) WHERE place <= 20")
def balanced_sample(spark, sf):
    return sampling.per_class(read(spark, sf, "labels"), "quality", "doc_id", 20, "b").select("doc_id", "quality", F.col("place").cast("long").alias("place"))


@query("SELECT lang, source, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('c:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 5 GROUP BY ALL")
def balanced_cells(spark, sf):
    cells = read(spark, sf, "documents").select("doc_id", "lang", "source", F.concat_ws("|", "lang", "source").alias("cell"))
    return sampling.per_class(cells, "cell", "doc_id", 5, "c").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR)) AS r FROM labels WHERE quality = 0) WHERE r <= 20 UNION ALL SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1")
def inspection_rows(spark, sf):
    rows = read(spark, sf, "labels")
    wrong = rows.filter("quality = 0").orderBy(F.sha2(F.col("doc_id").cast("string"), 256)).limit(20).select("doc_id")
    return wrong.unionByName(rows.filter("quality = 1 AND toxic = 1").select("doc_id"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS selection_order FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100)")
def manifest_limit(spark, sf):
    few = read(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").limit(100)
    return few.select("o_orderkey", (F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("selection_order"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_ten(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


_FOLD = """WITH r AS (SELECT l.doc_id, quality, lang, row_number() OVER (PARTITION BY quality, lang ORDER BY md5('2026:' || l.doc_id), l.doc_id) AS place FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT quality, lang, count(*) AS k FROM r GROUP BY ALL), o AS (SELECT quality, lang, coalesce(sum(k) OVER (PARTITION BY quality ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s),
f AS (SELECT doc_id, quality, ((off + place - 1) % 5)::INT AS fold FROM r JOIN o USING (quality, lang))"""


def _folds(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return sampling.folds(rows, "quality", "lang", "doc_id", 5, "2026")


@query(_FOLD + " SELECT doc_id, fold FROM f")
def round_robin_folds(spark, sf):
    return _folds(spark, sf).select("doc_id", "fold")


@query(_FOLD + " SELECT fold, quality, count(*) AS n FROM f GROUP BY ALL")
def fold_class_counts(spark, sf):
    return _folds(spark, sf).groupBy("fold", "quality").agg(F.count("*").alias("n"))


@query("SELECT source AS held_out, count(*) AS n_test, (SELECT count(*) FROM documents) - count(*) AS n_train FROM documents GROUP BY source")
def leave_one_group_out(spark, sf):
    by = read(spark, sf, "documents").groupBy(F.col("source").alias("held_out")).agg(F.count("*").alias("n_test"))
    return by.withColumn("n_train", F.sum("n_test").over(Window.partitionBy()) - F.col("n_test"))


_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT feature, count(v) AS valid, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, count(DISTINCT v) AS n_distinct, count(DISTINCT v) <= 1 AS constant, count(DISTINCT v) <= 0.02 * count(v) AS near_constant FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM lineitem" for c in _FEATURES) + ") GROUP BY feature")
def feature_statistics(spark, sf):
    long = read(spark, sf, "lineitem").select(*_FEATURES).unpivot([], list(_FEATURES), "feature", "v")
    by_value = long.groupBy("feature", "v").agg(F.count("v").alias("k"))  # counts per value first: no shuffle of all rows
    sums = by_value.groupBy("feature").agg(F.sum("k").alias("valid"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("m"), F.count("v").alias("n_distinct"))
    spread = by_value.join(sums.select("feature", "m"), "feature").groupBy("feature").agg(F.sqrt(F.sum(F.col("k") * (F.col("v") - F.col("m")) ** 2) / F.sum("k")).alias("s"))
    return sums.join(spread, "feature").select("feature", "valid", "low", "high", F.round("m", 4).alias("mean"), F.round("s", 4).alias("sd"), "n_distinct", (F.col("n_distinct") <= 1).alias("constant"), (F.col("n_distinct") <= 0.02 * F.col("valid")).alias("near_constant"))


@query("SELECT bool_and(o_orderkey IS NOT DISTINCT FROM o_orderkey + 0) AS same_key, bool_and(o_orderkey IS NOT DISTINCT FROM o_custkey) AS same_customer FROM orders")
def duplicate_features(spark, sf):
    o = read(spark, sf, "orders")
    return o.agg(F.bool_and(F.col("o_orderkey").eqNullSafe(F.col("o_orderkey") + 0)).alias("same_key"), F.bool_and(F.col("o_orderkey").eqNullSafe(F.col("o_custkey"))).alias("same_customer"))


@query("SELECT l_linenumber AS fold, max(l_tax) - min(l_tax) > 1e-12 AS tax_varies, max(l_linenumber) - min(l_linenumber) > 1e-12 AS line_varies FROM lineitem GROUP BY 1")
def varying_columns(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("fold")).agg((F.max("l_tax") - F.min("l_tax") > 1e-12).alias("tax_varies"), (F.max("l_linenumber") - F.min("l_linenumber") > 1e-12).alias("line_varies"))


_SIZE = "CASE WHEN a > 0 AND a < 1 THEN ceil(greatest(100 / a, 100 / (1 - a)){g})::BIGINT END"


@query(f"SELECT source, {_SIZE.format(g='')} AS plain, {_SIZE.format(g=' - 1e-12')} AS guarded FROM (SELECT source, avg(quality) AS a FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def sample_sizes(spark, sf):
    a = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("a"))
    return a.select("source", integrity.sample_size(F.col("a")).alias("plain"), integrity.sample_size(F.col("a"), 1e-12).alias("guarded"))


@query("""SELECT source, n, concat_ws(',', CASE WHEN NOT n >= 20 THEN 'count' END, CASE WHEN NOT long_share <= 0.05 THEN 'truncation' END, CASE WHEN NOT least(ok, n - ok) >= 20 THEN 'class_balance' END) AS reasons FROM
(SELECT source, count(*) AS n, avg((n_chars > 10000)::INT) AS long_share, sum(quality) AS ok FROM documents JOIN labels USING (doc_id) GROUP BY source)""")
def gate_reasons(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf, "labels"), "doc_id")
    g = d.groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("n_chars") > 10000).cast("int")).alias("long_share"), F.sum("quality").alias("ok"))
    return g.select("source", "n", integrity.reasons(("count", F.col("n") >= 20), ("truncation", F.col("long_share") <= 0.05), ("class_balance", F.least("ok", F.col("n") - F.col("ok")) >= 20)).alias("reasons"))


@query("SELECT lang, CASE WHEN ok < 20 THEN 'descriptive_only' WHEN ok < 50 THEN 'exploratory' WHEN ok < 100 THEN 'preliminary' ELSE 'suitable_for_primary_analysis' END AS decision, n - ok >= 20 AND ok >= 20 AS passed FROM (SELECT lang, count(*) AS n, sum(quality) AS ok FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def balance_gate(spark, sf):
    from ..operators.metrics import reliability

    d = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("ok"))
    return d.select("lang", reliability(F.col("ok")).alias("decision"), ((F.col("n") - F.col("ok") >= 20) & (F.col("ok") >= 20)).alias("passed"))


@query("SELECT doc_id, 'lang:' || lang || '|source:' || source AS stratum, lang AS first_value FROM documents")
def stratum_parse(spark, sf):
    s = F.concat(F.lit("lang:"), F.col("lang"), F.lit("|source:"), F.col("source"))
    return read(spark, sf, "documents").select("doc_id", s.alias("stratum")).select("doc_id", "stratum", F.str_to_map("stratum", F.lit("\\|"), F.lit(":"))["lang"].alias("first_value"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || chr(92) || 'n' || 'é' || '"' END || '}') AS digest FROM orders""")
def record_checksums(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.concat("o_orderpriority", F.lit("\né"))).alias("o_orderpriority"))
    return o.select("o_orderkey", integrity.checksum(o).alias("digest"))


_FIRST_LINE = "lower(split_part(text, '.', 1))"


@query(f"""SELECT min(a.doc_id) AS left_id, count(*) AS left_rows, b.doc_id AS right_id FROM (SELECT doc_id, {norm_sql(_FIRST_LINE)} AS k FROM documents WHERE doc_id % 5 <> 0) a JOIN (SELECT doc_id, {norm_sql(_FIRST_LINE)} AS k FROM documents WHERE doc_id % 5 = 0) b USING (k) WHERE k <> '' GROUP BY b.doc_id""")
def leakage_pairs(spark, sf):
    """Documents of a test split whose first sentence stands in the training split."""
    d = read(spark, sf, "documents").select("doc_id", T.normalised(F.lower(F.split_part("text", F.lit("."), F.lit(1)))).alias("k"))
    return integrity.leakage(d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 5 = 0"), "k", "doc_id", "doc_id")


_SOURCED = "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN doc_id % 7 < 2 THEN CAST(CAST(floor(doc_id / 7) AS INT) AS {s}) ELSE '' END AS src, {first} AS question FROM {t}"
_KEYS = f"SELECT id, split, 'shared_source_id' AS reason, src AS k FROM ({{rows}}) WHERE src <> '' UNION ALL SELECT id, split, 'normalized_question_overlap', {norm_sql('question')} FROM ({{rows}}) WHERE {norm_sql('question')} <> ''".replace("{rows}", _SOURCED.format(s="VARCHAR", t="documents", first=_FIRST_LINE))


def _sourced(spark, sf):
    rows = spark.sql(_SOURCED.format(s="STRING", t="{docs}", first="split_part(text, '.', 1)"), docs=read(spark, sf, "documents"))
    return rows.select(F.col("id").alias("example_id"), "split", F.col("src").alias("source_id"), "question")


@query(f"""WITH k AS ({_KEYS}), h AS (SELECT reason, k, min(id) AS first FROM k GROUP BY 1, 2), s AS (SELECT reason, k, split, min(id) AS first FROM k GROUP BY 1, 2, 3)
SELECT reason, id AS excluded_id, first AS matched_id FROM k JOIN h USING (reason, k) WHERE id <> first
UNION ALL SELECT 'cross_split_overlap', a.id, min(s.first) FROM k a JOIN s ON a.reason = s.reason AND a.k = s.k AND a.split <> s.split WHERE a.id > s.first GROUP BY a.id""")
def leakage_overlaps(spark, sf):
    """Documents that share a source or a first sentence, and those whose match is in the other split, each with the first one."""
    return overlaps.overlaps(_sourced(spark, sf))


@query(f"""WITH RECURSIVE k AS MATERIALIZED ({_KEYS}), h AS MATERIALIZED (SELECT reason, k, min(id) AS first FROM k GROUP BY 1, 2), e AS MATERIALIZED (SELECT DISTINCT id AS a, first AS b FROM k JOIN h USING (reason, k) UNION SELECT DISTINCT first, id FROM k JOIN h USING (reason, k)),
r(a, g) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.g FROM r JOIN e USING (a) WHERE e.b > r.g OR e.b <> r.a), m AS (SELECT a AS id, min(g) AS g FROM r GROUP BY 1)
SELECT m.id AS example_id, g AS "group", count(*) OVER (PARTITION BY g) AS size FROM m""")
def leakage_groups(spark, sf):
    """Which documents hang together through shared sources and first sentences."""
    return overlaps.groups(_sourced(spark, sf)).select("example_id", "group", "size")


@query("SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::DOUBLE AS automobile, (c_mktsegment = 'BUILDING')::DOUBLE AS building FROM customer")
def one_hot(spark, sf):
    hot = lambda v: (F.col("c_mktsegment") == v).cast("double")
    return read(spark, sf, "customer").select("c_custkey", hot("AUTOMOBILE").alias("automobile"), hot("BUILDING").alias("building"))


@query("SELECT label, i::INT AS i, round(avg(e[i + 1]), 6) AS mean FROM (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), range(64) r(i) GROUP BY ALL")
def mean_profile_by_class(spark, sf):
    v = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return v.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def seed_mean_scores(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT CASE WHEN l.quality IS NULL THEN 'unlabelled' WHEN l.toxic = 1 AND l.quality = 0 THEN 'both' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'poor' WHEN d.n_chars > 5000 THEN 'long' ELSE 'plain' END AS category, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def category_cascade(spark, sf):
    x = read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    c = F.when(q.isNull(), "unlabelled").when((t == 1) & (q == 0), "both").when(t == 1, "toxic").when(q == 0, "poor").when(F.col("n_chars") > 5000, "long").otherwise("plain")
    return x.groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (WHERE value < 10) AS bad, count(*) FILTER (WHERE value < 10) / count(*) AS share FROM events GROUP BY 1")
def event_rates(spark, sf):
    return monitor.rate(read(spark, sf, "events"), "ts", F.col("value") < 10)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def counts_by_key(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN FALSE ELSE quality = 1 END AS correct, coalesce(1 - quality, 0) AS err FROM documents LEFT JOIN labels l USING (doc_id)")
def correctness_fallback(spark, sf):
    x = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return x.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("correct"), F.coalesce(1 - F.col("quality"), F.lit(0)).alias("err"))


@query("SELECT o_orderkey, l_linenumber, o_orderpriority, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def three_way_join(spark, sf):
    l = read(spark, sf, "lineitem").filter("l_shipdate >= TIMESTAMP '1998-01-01'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("c_custkey"))
    return l.join(o, "o_orderkey").join(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("o_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT md5(text)) AS texts, count(*) = count(DISTINCT doc_id) AS unique_ids FROM documents GROUP BY lang")
def manifest_validation(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct(F.md5("text")).alias("texts"), (F.count("*") == F.countDistinct("doc_id")).alias("unique_ids"))
