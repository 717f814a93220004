"""Registered queries on features: signatures of vectors, families of columns, filters and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import features as X
from ..operators import metrics, tails
from .text_queries import read
from .value_queries import _L, _MOVES, _SOFT, _T, _distributions, _moves, _scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(x):
    return F.round(x, 6)


def _cells(spark, sf):
    """(vec_id, label, cells): for each of four tokens the relative changes of seven transitions."""
    per = _moves(spark, sf).groupBy("vec_id", "label", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "relative"))), lambda x: x["relative"]).alias("c"))
    return per.groupBy("vec_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "c"))), lambda x: x["c"]).alias("cells"))


_P = f"SELECT vec_id, l, avg(relative) AS m FROM ({_MOVES}) GROUP BY ALL"
_REGION = "CASE WHEN l <= 3 THEN 'early' WHEN l <= 5 THEN 'middle' ELSE 'late' END"


@query(f"SELECT vec_id, {_REGION} AS region, round(avg(relative), 6) AS mean, round(stddev_pop(relative), 6) AS std, round(max(relative), 6) AS max, round(max(relative) - min(relative), 6) AS \"range\" FROM ({_MOVES}) GROUP BY ALL")
def region_statistics(spark, sf):
    """Early, middle and late transitions of all tokens."""
    out, x = None, _cells(spark, sf).select("vec_id", F.struct(*(v.alias(k) for k, v in A.profile(F.col("cells"), 7).items())).alias("p"))
    for region in ("early", "middle", "late"):
        part = x.select("vec_id", F.lit(region).alias("region"), *(r6(F.col(f"p.{region}_{k}")).alias(k) for k in ("mean", "std", "max", "range")))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH r AS (SELECT vec_id, avg(relative) FILTER (WHERE l <= 3) AS a, avg(relative) FILTER (WHERE l IN (4, 5)) AS b, avg(relative) FILTER (WHERE l >= 6) AS c FROM ({_MOVES}) GROUP BY 1),
w AS (SELECT *, lag(m) OVER o AS b, lag(m, 2) OVER o AS c FROM ({_P}) WINDOW o AS (PARTITION BY vec_id ORDER BY l)),
s AS (SELECT vec_id, avg(m) AS mean, stddev_pop(m) AS std, regr_slope(m, l) AS slope, avg(abs(m - b)) AS roughness, avg(abs(m - 2 * b + c)) AS curvature, max(m) AS maximum, arg_max(l, m) - 1 AS peak FROM w GROUP BY 1)
SELECT vec_id, round(mean, 6) AS mean, round(std, 6) AS std, round(slope, 6) AS slope, round(roughness, 6) AS roughness, round(curvature, 6) AS curvature, round(maximum, 6) AS maximum, peak::INT AS peak, round(peak / 6, 6) AS peak_place,
round(r.a / (r.b + 1e-8::DOUBLE), 5) AS early_to_middle, round(r.b / (r.c + 1e-8::DOUBLE), 5) AS middle_to_late, round(r.a / (r.c + 1e-8::DOUBLE), 5) AS early_to_late FROM s JOIN r USING (vec_id)""")
def profile_features(spark, sf):
    names = ("mean", "std", "slope", "roughness", "curvature", "maximum", "peak_place")
    x = _cells(spark, sf).select("vec_id", F.struct(*(v.alias(k) for k, v in A.profile(F.col("cells"), 7).items())).alias("p"))
    return x.select("vec_id", "p.peak", *(r6(F.col(f"p.{k}")).alias(k) for k in names), *(F.round(f"p.{k}", 5).alias(k) for k in ("early_to_middle", "middle_to_late", "early_to_late")))


_INSTABLE = f"SELECT vec_id, t, avg(cosine) AS m FROM ({_MOVES}) WHERE l - 1 >= 1 AND l - 1 < 6 AND t < CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 4 END GROUP BY ALL"


@query(f"""SELECT vec_id, CASE WHEN count(*) >= 2 THEN round(stddev_pop(m), 6) END AS scalar, round(avg(m), 6) AS mean, round(min(m), 6) AS low, round(max(m), 6) AS high, round(arg_min(m, t), 6) AS "first", round(arg_max(m, t), 6) AS "last", round(CASE WHEN count(*) >= 2 THEN regr_slope(m, t) ELSE 0 END, 6) AS slope,
round(coalesce(avg(abs(m - b)), 0), 6) AS roughness, (arg_max(t, m))::INT AS peak FROM (SELECT *, lag(m) OVER (PARTITION BY vec_id ORDER BY t) AS b FROM ({_INSTABLE})) GROUP BY vec_id""")
def token_signatures(spark, sf):
    """Instability from token to token; every fifth answer has one token and so no scalar."""
    low, high = A.interior(F.lit(7))
    kept = _moves(spark, sf).filter((F.col("l") - 1 >= low) & (F.col("l") - 1 < high) & (F.col("t") < F.when(F.col("vec_id") % 5 == 0, 1).otherwise(4)))
    per = kept.groupBy("vec_id", "t").agg(F.avg("cosine").alias("m")).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "m"))), lambda x: x["m"]).alias("a"))
    d = A.dynamics(F.col("a"))
    return per.select("vec_id", F.when(F.size("a") >= 2, r6(d["std"])).alias("scalar"), r6(d["mean"]).alias("mean"), r6(d["min"]).alias("low"), r6(d["max"]).alias("high"), r6(d["first"]).alias("first"), r6(d["last"]).alias("last"), r6(d["slope"]).alias("slope"), r6(d["roughness"]).alias("roughness"), d["peak"].alias("peak"))


@query(f"SELECT vec_id, 2::INT AS tokens, 7::INT AS levels, round(e[35] + e[36], 6) AS first_sum FROM ({_T})")
def aligned_states(spark, sf):
    """States of the answer alone: without the embedding level and the two tokens of a prompt."""
    v = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda l: F.slice("e", t * 16 + l * 2 + 1, F.lit(2))))
    x = v.select("vec_id", A.aligned(tokens, F.lit(2), 8).alias("a"))
    return x.select("vec_id", F.size("a").alias("tokens"), F.size(F.col("a")[0]).alias("levels"), r6(A.total(F.col("a")[0][0])).alias("first_sum"))


@query(f"{_SOFT} SELECT vec_id, round(-list_sum(list_transform(p, lambda v: greatest(v, 1e-12::DOUBLE) * ln(greatest(v, 1e-12::DOUBLE)))), 6) AS entropy FROM q")
def floored_entropy(spark, sf):
    return _distributions(spark, sf).select("vec_id", r6(A.floored_entropy(F.col("p"))).alias("entropy"))


_TOKEN = f"{_SOFT}, k AS (SELECT vec_id // 5 AS response, ln(p[label + 1]) AS lp, -list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) AS h, list_reverse_sort(p)[1] - list_reverse_sort(p)[2] AS g FROM q)"


@query(f"{_TOKEN} SELECT response, round(avg(h), 6) AS entropy_mean, round(max(h), 6) AS entropy_max, round(min(h), 6) AS entropy_min, round(stddev_pop(h), 6) AS entropy_std, round(avg(lp), 6) AS logp_mean, round(min(lp), 6) AS logp_min, round(max(lp), 6) AS logp_max, round(-avg(lp), 6) AS nll, round(stddev_pop(lp), 6) AS logp_std, round(sum(lp), 5) AS logp_sum, round(avg(g), 6) AS margin_mean, round(min(g), 6) AS margin_min, count(*) AS tokens FROM k GROUP BY response")
def response_summaries(spark, sf):
    """All summaries of a response's tokens."""
    k = _distributions(spark, sf).select(F.expr("vec_id div 5").alias("response"), F.log(F.get("p", F.col("label"))).alias("lp"), A.entropy(F.col("p")).alias("h"), A.margin(F.col("p")).alias("g"))
    return k.groupBy("response").agg(
        *(r6(f("h")).alias(f"entropy_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_pop))),
        *(r6(f("lp")).alias(f"logp_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))),
        r6(-F.avg("lp")).alias("nll"), F.round(F.sum("lp"), 5).alias("logp_sum"), r6(F.avg("g")).alias("margin_mean"), r6(F.min("g")).alias("margin_min"), F.count("*").alias("tokens"),
    )


@query("SELECT vec_id, (vec_id % 4 = 0)::INT + (vec_id % 6 = 0)::INT AS bad_leaves FROM embeddings")
def nonfinite_leaves(spark, sf):
    """Numbers that aren't finite in any leaf of a nested record."""
    v = read(spark, sf, "embeddings").select("vec_id", F.struct(F.when(F.col("vec_id") % 4 == 0, float("nan")).otherwise(1.0).alias("a"), F.struct(F.when(F.col("vec_id") % 6 == 0, float("inf")).otherwise(2.0).alias("b"), F.col("embedding").alias("c")).alias("n")).alias("record"))
    return v.select("vec_id", X.bad_leaves(v, "record").alias("bad_leaves"))


_FLAGS = "SELECT d.doc_id, n_chars, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.doc_id % 2 = 0 END AS answerable, CASE WHEN d.doc_id % 7 > 0 THEN n_chars > 3000 END AS truncated, 1 - quality AS err FROM documents d LEFT JOIN labels l USING (doc_id)"


def _flags(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2 == 0).alias("answerable"), F.when(F.col("doc_id") % 7 > 0, F.col("n_chars") > 3000).alias("truncated"))
    return d.join(read(spark, sf, "labels"), "doc_id", "left").withColumn("err", 1 - F.col("quality")).select("doc_id", "n_chars", F.struct("answerable").alias("metrics"), "truncated", "err")


@query(f"SELECT 'answerable' AS subset, count(*) AS n FROM ({_FLAGS}) WHERE answerable = TRUE UNION ALL SELECT 'unanswerable', count(*) FROM ({_FLAGS}) WHERE answerable = FALSE UNION ALL SELECT 'resolved', count(*) FROM ({_FLAGS}) WHERE err IS NOT NULL AND NOT coalesce(truncated, FALSE)")
def flag_subsets(spark, sf):
    """Subsets by a nested flag that may be missing, and rows that are resolved and whole."""
    x = _flags(spark, sf)
    parts = (("answerable", X.flag_is("metrics.answerable", True)), ("unanswerable", X.flag_is("metrics.answerable", False)), ("resolved", X.resolved("err", "truncated")))
    out = None
    for name, condition in parts:
        row = x.filter(condition).agg(F.lit(name).alias("subset"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


_V = ("n_chars", "n_words", "n_lines", "truncated")
_TABLE = "SELECT doc_id, n_chars::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS n_words, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS n_lines, (n_chars > 3000)::DOUBLE AS truncated FROM documents WHERE text IS NOT NULL"


def document_features(spark, sf):
    """Flat and nested features of documents."""
    d = read(spark, sf, "documents").filter("text is not null")
    words = F.split("text", " ")
    return d.select("doc_id", "lang", F.struct("n_chars", F.size(words).alias("n_words"), F.struct((F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_lines"), (F.col("n_chars") > 3000).alias("truncated")).alias("shape"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.length(F.get(words, i))).alias("first")).alias("features"))


@query("SELECT doc_id, feature, value FROM (SELECT doc_id, unnest(['first_00', 'first_01', 'first_02', 'n_chars', 'n_words', 'shape_n_lines', 'shape_truncated']) AS feature, unnest([length(w[1])::DOUBLE, length(w[2])::DOUBLE, length(w[3])::DOUBLE, n_chars::DOUBLE, len(w)::DOUBLE, (length(text) - length(replace(text, chr(10), '')))::DOUBLE, (n_chars > 3000)::DOUBLE]) AS value FROM (SELECT *, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL))")
def flattened_features(spark, sf):
    """Nested numbers, lists and flags as columns of doubles by their path, then as rows."""
    x = document_features(spark, sf)
    flat = X.flattened(x, "features", {"first": 3})
    return x.select("doc_id", *(c.alias(n) for n, c in flat.items())).unpivot(["doc_id"], list(flat), "feature", "value")


@query(f"SELECT doc_id, n_chars, n_words FROM ({_TABLE})")
def family_projection(spark, sf):
    """The features of two families in their order; a name that isn't there is an error."""
    x = document_features(spark, sf)
    flat = x.select("doc_id", *(c.alias(n) for n, c in X.flattened(x, "features", {"first": 3}).items()))
    return X.family(flat, "doc_id", {"L": ["n_chars"], "W": ["n_words"]}, ("L", "W"))


@query(f"SELECT doc_id, n_chars, n_words FROM ({_TABLE}) ")
def compact_projection(spark, sf):
    """A named few of many features, and all but those whose name holds a part."""
    x = document_features(spark, sf)
    flat = x.select("doc_id", *(c.alias(n) for n, c in X.flattened(x, "features", {"first": 3}).items()))
    rest = X.without(flat, ("shape", "first"))
    return X.compact(rest, "doc_id", ("n_chars", "n_words"))


@query(f"SELECT doc_id, l_chars, s_lines, s_truncated, w_words FROM (SELECT doc_id, n_chars AS l_chars, n_lines AS s_lines, truncated AS s_truncated, n_words AS w_words FROM ({_TABLE}))")
def union_matrix(spark, sf):
    """All columns of chosen families by qualified names, in order."""
    x = document_features(spark, sf).select("doc_id", F.struct(F.col("features.n_chars").cast("double").alias("chars")).alias("l"), F.struct(F.col("features.shape.n_lines").cast("double").alias("lines"), F.col("features.shape.truncated").cast("double").alias("truncated")).alias("s"), F.struct(F.col("features.n_words").cast("double").alias("words")).alias("w"))
    return X.matrix(x, "doc_id", ("w", "s", "l"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_partkey END::BIGINT AS value FROM part")
def preferred_records(spark, sf):
    """A field of the selected option where there is one, else of the record."""
    p = read(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.struct(F.col("p_size").cast("long").alias("value"))).alias("selected_option"), F.col("p_partkey").alias("value"))
    return p.select("p_partkey", X.prefer(p, "selected_option", "value").alias("value"))


_PREFIX = {"E": "early", "M": "middle", "A": "late"}


@query("SELECT 'E' AS region, 6 AS columns, 'early_max,early_mean,early_range,early_std,early_to_late,early_to_middle' AS names UNION ALL SELECT 'M', 5, 'middle_max,middle_mean,middle_range,middle_std,middle_to_late' UNION ALL SELECT 'A', 4, 'late_max,late_mean,late_range,late_std'")
def region_columns(spark, sf):
    """Columns by the prefix of their region: ratios count to the region that they begin with."""
    x = _cells(spark, sf).select("vec_id", *(v.cast("double").alias(k) for k, v in A.profile(F.col("cells"), 7).items()))
    rows = [(k, len(names), ",".join(names)) for k, prefix in _PREFIX.items() for names in [X.by_prefix(x, prefix)]]
    return spark.createDataFrame(rows, "region string, columns int, names string")


@query("SELECT o_orderkey, o_custkey FROM orders")
def without_secrets(spark, sf):
    """A nested record without the fields that must not leave canonical data."""
    o = read(spark, sf, "orders").select("o_orderkey", F.struct("o_custkey", F.lit("gold").alias("reference_answer"), F.lit("m").alias("matched_aliases")).alias("metrics"))
    x = o.withColumn("metrics", F.col("metrics").dropFields("reference_answer", "matched_aliases"))
    return x.select("o_orderkey", "metrics.*")


_LABELS = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"


@query("SELECT p_partkey, (p_partkey % 3 > 0)::INT AS strict, (p_partkey % 3 > 1)::INT AS alias, (NOT (p_partkey % 3 <= 1 AND p_size / 50.0::DOUBLE >= 0.8))::INT AS verified FROM part")
def label_families(spark, sf):
    """Errors by strict match, by alias, and by alias with enough overlap."""
    strict, alias = F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 3 <= 1
    return read(spark, sf, "part").select("p_partkey", *(c.alias(n) for n, c in X.error_variants(strict, alias, F.col("p_size") / 50.0).items()))


@query("SELECT doc_id, lang, target FROM (SELECT doc_id, lang, CASE WHEN doc_id % 4 > 0 THEN 1 - quality END AS target FROM documents JOIN labels USING (doc_id)) WHERE target IS NOT NULL")
def relabelled_rows(spark, sf):
    """New targets joined to the records; rows without one go."""
    labels = read(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 4 > 0, 1 - F.col("quality")).alias("target"))
    return X.relabelled(read(spark, sf, "documents").select("doc_id", "lang"), labels, "doc_id", "target")


@query("SELECT p_partkey, " + ", ".join(f"(p_type = '{t}')::DOUBLE AS type_{t.lower()}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")) + " FROM part")
def one_hot_levels(spark, sf):
    """A column for each level but the last."""
    return X.one_hot(read(spark, sf, "part").select("p_partkey", "p_type"), "p_type", "type_")


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_partkey % 2 = 0 WHEN p_partkey % 6 = 1 THEN p_size > 25 WHEN p_partkey % 6 = 2 THEN p_size > 10 WHEN p_partkey % 6 = 3 THEN p_size > 40 ELSE p_partkey % 6 = 4 END AS correct FROM part")
def correctness_chain(spark, sf):
    """The first of: error label (a null one that is there is no error), exact match, correct, numeric match; false if none is there."""
    k, s = F.col("p_partkey") % 6, F.col("p_size")
    p = read(spark, sf, "part").select("p_partkey", F.when(k == 0, F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(1)).alias("error"), k.isin(0, 4).alias("labelled"), F.when(k == 1, s > 25).alias("exact"), F.when(k == 2, s > 10).alias("correct"), F.when(k == 3, s > 40).alias("numeric"))
    return p.select("p_partkey", X.first_verdict("error", "exact", "correct", "numeric", present=F.col("labelled")).alias("correct"))


@query("SELECT o_orderstatus, count(*) AS n, max(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END) AS high, max(CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS top FROM orders GROUP BY 1")
def group_maxima(spark, sf):
    """Largest values where there are any, null where a group has none."""
    o = read(spark, sf, "orders")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))).alias("high"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("top"))


_KEYS = {
    "operation": ("CASE WHEN l_linenumber % 3 = 0 THEN '+' WHEN l_linenumber % 3 = 1 THEN '-' ELSE '*' END", lambda c: F.when(c("l_linenumber") % 3 == 0, "+").when(c("l_linenumber") % 3 == 1, "-").otherwise("*")),
    "seed": ("(l_suppkey % 5)::VARCHAR", lambda c: (c("l_suppkey") % 5).cast("string")),
    "by eight": ("least(3, l_quantity::INT // 8)::VARCHAR", lambda c: X.bucket(c("l_quantity"), 8)),
    "by twelve": ("least(3, l_quantity::INT // 12)::VARCHAR", lambda c: X.bucket(c("l_quantity"), 12)),
    "small": ("CASE WHEN abs(l_partkey - 100) < 100 THEN 'true' ELSE 'false' END", lambda c: (F.abs(c("l_partkey") - 100) < 100).cast("string")),
    "flag": ("l_returnflag", lambda c: c("l_returnflag")),
    "status": ("l_linestatus", lambda c: c("l_linestatus")),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS \"key\", {sql} AS value, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS correct, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2" for k, (sql, _) in _KEYS.items()))
def subgroup_keys(spark, sf):
    """Subgroups by every derived key at once: each row is counted under each key before any shuffle."""
    l = read(spark, sf, "lineitem")
    keyed = l.select("l_returnflag", "l_quantity", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), f(F.col).alias("value")) for k, (_, f) in _KEYS.items()))).alias("k"))
    return keyed.groupBy("k.key", "k.value").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("correct"), r6(F.avg("l_quantity")).alias("mean"))


@query("""SELECT 'label' AS field, coalesce(quality::VARCHAR, 'None') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL""")
def value_distributions(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "source").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return X.distributions(d, {"label": F.coalesce(F.col("quality").cast("string"), F.lit("None")), "lang": F.col("lang"), "source": F.col("source")})


@query("SELECT 'a,c' AS columns, 2 AS n UNION ALL SELECT 'b,d', 2")
def duplicate_groups(spark, sf):
    """Columns that hold the same values in all rows, found by a digest of each column."""
    l = read(spark, sf, "lineitem")
    x = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") * 1).alias("c"), (F.col("l_tax") + 0).alias("d"), F.col("l_discount").alias("e"))
    groups = X.equal_columns(x, "id", ["a", "b", "c", "d", "e"])
    return spark.createDataFrame([(",".join(g), len(g)) for g in groups], "columns string, n int")


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'lexical' WHEN p_partkey % 4 = 1 THEN 'status' ELSE 'none' END AS category, count(*) AS n FROM part GROUP BY 1")
def category_fallback(spark, sf):
    """The first category that a record has."""
    k = F.col("p_partkey") % 4
    p = read(spark, sf, "part").select(F.when(k == 0, "lexical").alias("a"), F.when(k <= 1, "status").alias("b"))
    return p.groupBy(F.coalesce("a", "b", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


# statistics


@query(f"""WITH c AS (SELECT *, 1 - least(n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) AS cover FROM ({_L})), r AS (SELECT lang, sum(err) OVER w / row_number() OVER w AS risk FROM c WINDOW w AS (PARTITION BY lang ORDER BY -cover, doc_id ROWS UNBOUNDED PRECEDING))
SELECT lang, round(avg(risk), 6) AS mean_risk FROM r GROUP BY lang""")
def quality_ranking(spark, sf):
    """Mean cumulative risk when rows are taken by falling coverage."""
    x = _scored(spark, sf).withColumn("uncovered", -(1 - F.col("score")))
    return metrics.mean_risk(metrics.risk_curve(x, "uncovered", "err", "doc_id", ["lang"]), ["lang"]).select("lang", r6(F.col("mean_risk")).alias("mean_risk"))


_AUCS = " UNION ALL ".join(f"SELECT '{name}' AS family, (SELECT (sum(r * err) - sum(err) * (sum(err) + 1) / 2.0::DOUBLE) / (sum(err) * (count(*) - sum(err))) FROM (SELECT err, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r FROM ({_L}))) AS auroc" for name, score in (("length", "score"), ("toxic", "toxic"), ("joint", "score + toxic")))


@query(f"WITH a AS ({_AUCS}) SELECT family, round(auroc, 6) AS auroc, round(auroc - (SELECT auroc FROM a WHERE family = 'length'), 6) AS gain FROM a")
def gains_on_baseline(spark, sf):
    rows, out = _scored(spark, sf).withColumn("joint", F.col("score") + F.col("toxic")), None
    for name, score in (("length", "score"), ("toxic", "toxic"), ("joint", "joint")):
        part = metrics.auroc(rows.withColumn("family", F.lit(name)), score, "err", ["family"]).select("family", "auroc")
        out = part if out is None else out.unionByName(part)
    return metrics.gains(out, [], "family", "auroc", "length").select("family", r6(F.col("auroc")).alias("auroc"), r6(F.col("gain")).alias("gain"))


#: Two-sided tail of Student's t, by Simpson's rule over its density from 0 to t.
_TAIL = "(SELECT 1 - 2 * t / 12000.0 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + (t * i / 4000.0) * (t * i / 4000.0) / v, -(v + 1) / 2)) FROM range(4001) q(i))"


@query(f"""WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY lang ORDER BY err) + (count(*) OVER (PARTITION BY lang, err) - 1) / 2.0::DOUBLE AS b FROM ({_L})),
c AS (SELECT lang, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS rho FROM r GROUP BY lang), x AS (SELECT lang, rho, (n - 2)::DOUBLE AS v, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c) SELECT lang, round(rho, 6) AS spearman, round({_TAIL}, 6) AS p FROM x""")
def rank_correlation_p(spark, sf):
    """Rank correlations with their two-sided p, as columns of a table of results."""
    rows = _scored(spark, sf)
    found = metrics.spearman(rows, "n_chars", "err", ["lang"]).join(rows.groupBy("lang").agg(F.count("*").alias("n")), "lang")
    return found.select("lang", r6(F.col("spearman")).alias("spearman"), r6(tails.correlation_p(F.col("spearman"), F.col("n"))).alias("p"))
