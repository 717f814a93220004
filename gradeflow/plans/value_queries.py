"""Registered queries on vectors, rankings, calibration, resampling and learners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import learners, metrics, resamples
from .text_queries import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# The answer tensor: 64 numbers as 4 tokens of 8 layers of 2 dimensions.
_T = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings"
_LAYERS = f"SELECT vec_id, label, t, l, e[t * 16 + l * 2 + 1] AS x, e[t * 16 + l * 2 + 2] AS y FROM ({_T}), range(4) a(t), range(8) b(l)"
_MOVES = f"""SELECT vec_id, label, t, l, 1.0::DOUBLE - (x * px + y * py) / (greatest(sqrt(x * x + y * y), 1e-8::DOUBLE) * greatest(sqrt(px * px + py * py), 1e-8::DOUBLE)) AS cosine,
sqrt((x - px) * (x - px) + (y - py) * (y - py)) / greatest(sqrt(px * px + py * py), 1e-8::DOUBLE) AS relative
FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ({_LAYERS}) WINDOW w AS (PARTITION BY vec_id, t ORDER BY l)) WHERE px IS NOT NULL"""


def _moves(spark, sf):
    """(vec_id, label, t, l, cosine, relative): change from each layer to the next, without a shuffle."""
    v = read(spark, sf, "embeddings")
    rows = v.select("vec_id", "label", F.col("embedding").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("t")).select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("l"))
    at = F.col("t") * 16 + F.col("l") * 2
    old, new = F.slice("e", at - 1, F.lit(2)), F.slice("e", at + 1, F.lit(2))
    return rows.select("vec_id", "label", "t", "l", A.cosine_distance(old, new).alias("cosine"), A.relative_change(old, new).alias("relative"))


@query(f"SELECT vec_id, t::INT AS t, l::INT AS l, round(cosine, 6) AS cosine, round(relative, 6) AS relative FROM ({_MOVES})")
def layer_transitions(spark, sf):
    return _moves(spark, sf).select("vec_id", "t", "l", F.round("cosine", 6).alias("cosine"), F.round("relative", 6).alias("relative"))


@query(f"SELECT vec_id, round(stddev_pop(m), 6) AS instability FROM (SELECT vec_id, t, avg(cosine) AS m FROM ({_MOVES}) WHERE l - 1 >= 1 AND l - 1 < 6 GROUP BY ALL) GROUP BY vec_id")
def interior_instability(spark, sf):
    low, high = A.interior(F.lit(7))
    per = _moves(spark, sf).filter((F.col("l") - 1 >= low) & (F.col("l") - 1 < high)).groupBy("vec_id", "t").agg(F.avg("cosine").alias("m"))
    return per.groupBy("vec_id").agg(F.round(F.stddev_pop("m"), 6).alias("instability"))


_PROFILE = f"SELECT vec_id, list(m ORDER BY l) AS p FROM (SELECT vec_id, l, avg(relative) AS m FROM ({_MOVES}) GROUP BY ALL) GROUP BY vec_id"


def _profiles(spark, sf):
    per = _moves(spark, sf).groupBy("vec_id", "l").agg(F.avg("relative").alias("m"))
    return per.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("l", "m"))), lambda x: x["m"]).alias("p"))


@query(f"""SELECT vec_id, i::INT AS i, round(p[lo + 1] + (x - lo) * (p[least(lo + 1, 6) + 1] - p[lo + 1]), 6) AS value FROM (SELECT vec_id, p, i, i * 6 / 31.0::DOUBLE AS x, floor(i * 6 / 31.0::DOUBLE)::INT AS lo FROM ({_PROFILE}), range(32) r(i))""")
def profile_resampled(spark, sf):
    return _profiles(spark, sf).select("vec_id", F.posexplode(A.resampled(F.col("p"), 32)).alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("value"))


@query(f"""SELECT vec_id, round(list_min(p), 6) AS low, round(list_max(p), 6) AS high, round(list_max(p) - list_min(p), 6) AS span, (list_position(p, list_max(p)) - 1)::INT AS peak,
round((p[1] + p[2] + p[3]) / 3, 6) AS early, round((p[4] + p[5]) / 2, 6) AS middle, round((p[6] + p[7]) / 2, 6) AS late FROM ({_PROFILE})""")
def profile_shape(spark, sf):
    p = F.col("p")
    mean = lambda a, k: F.round(F.aggregate(F.slice(p, a, k), F.lit(0.0), lambda s, x: s + x) / k, 6)
    return _profiles(spark, sf).select("vec_id", F.round(F.array_min(p), 6).alias("low"), F.round(F.array_max(p), 6).alias("high"), F.round(F.array_max(p) - F.array_min(p), 6).alias("span"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("peak"), mean(1, 3).alias("early"), mean(4, 2).alias("middle"), mean(6, 2).alias("late"))


@query(f"""WITH v AS (SELECT vec_id, i, e[i] AS x FROM ({_T}), range(1, 65) r(i)), w AS (SELECT *, lag(x) OVER o AS b, lag(x, 2) OVER o AS c FROM v WINDOW o AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, round(avg(abs(x - b)), 6) AS roughness, round(avg(abs(x - 2 * b + c)), 6) AS curvature, round(regr_slope(x, i), 6) AS slope FROM w GROUP BY vec_id""")
def sequence_dynamics(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "x"))
    o = Window.partitionBy("vec_id").orderBy("i")
    w = v.withColumn("b", F.lag("x").over(o)).withColumn("c", F.lag("x", 2).over(o))
    return w.groupBy("vec_id").agg(F.round(F.avg(F.abs(F.col("x") - F.col("b"))), 6).alias("roughness"), F.round(F.avg(F.abs(F.col("x") - 2 * F.col("b") + F.col("c"))), 6).alias("curvature"), F.round(F.regr_slope("x", "i"), 6).alias("slope"))


@query(f"SELECT vec_id, round(list_sum(list_slice(e, 55, 64)), 6) AS tail_sum FROM ({_T})")
def tail_window(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(A.tail(e, 10), F.lit(0.0), lambda s, x: s + x), 6).alias("tail_sum"))


_SOFT = f"SELECT vec_id, label, e, list_transform(x, lambda v: v / list_sum(x)) AS p FROM (SELECT *, list_transform(e, lambda v: exp(v - list_max(e))) AS x FROM ({_T}))"
_SOFT = f"WITH t AS ({_T}), m AS (SELECT *, list_max(e) AS top FROM t), x AS (SELECT *, list_transform(e, lambda v: exp(v - top)) AS x FROM m), s AS (SELECT *, list_sum(x) AS total FROM x), q AS (SELECT vec_id, label, e, list_transform(x, lambda v: v / total) AS p FROM s)"


def _distributions(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", "label", "embedding", A.softmax(F.col("embedding")).alias("p"))


@query(f"{_SOFT} SELECT vec_id, round(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)), 6) AS entropy, round(ln(p[label + 1]), 6) AS logp, (1 + len(list_filter(e, lambda v: v > e[label + 1])))::INT AS rank, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, (list_position(p, list_max(p)) - 1)::INT AS top FROM q")
def token_probabilities(spark, sf):
    p, chosen = F.col("p"), F.get("embedding", F.col("label"))
    return _distributions(spark, sf).select("vec_id", F.round(A.entropy(p), 6).alias("entropy"), F.round(F.log(F.get(p, F.col("label"))), 6).alias("logp"), A.rank_of(F.col("embedding"), chosen).alias("rank"), F.round(A.margin(p), 6).alias("margin"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("top"))


@query(f"{_SOFT} SELECT vec_id // 5 AS response, count(*) AS tokens, round(avg(ln(p[label + 1])), 6) AS mean, round(min(ln(p[label + 1])), 6) AS low, round(stddev_pop(ln(p[label + 1])), 6) AS sd, round(exp(-avg(ln(p[label + 1]))), 5) AS perplexity FROM q GROUP BY 1")
def response_probabilities(spark, sf):
    lp = F.log(F.get("p", F.col("label")))
    return _distributions(spark, sf).groupBy(F.expr("vec_id div 5").alias("response")).agg(F.count("*").alias("tokens"), F.round(F.avg(lp), 6).alias("mean"), F.round(F.min(lp), 6).alias("low"), F.round(F.stddev_pop(lp), 6).alias("sd"), F.round(F.exp(-F.avg(lp)), 5).alias("perplexity"))


@query(f"{_SOFT} SELECT vec_id, (list_position(o, list_max(o)) - 1)::INT AS choice, round(o[1] + o[2], 6) AS true_mass, round(list_sum(o[3:8]), 6) AS false_mass FROM (SELECT vec_id, list_transform(range(8), lambda k: list_sum(p[k * 8 + 1 : k * 8 + 8])) AS o FROM q)")
def option_masses(spark, sf):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    o = A.bound(F.col("p"), lambda p: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: total(F.slice(p, k * 8 + 1, F.lit(8)))))
    x = _distributions(spark, sf).select("vec_id", o.alias("o"))
    return x.select("vec_id", (F.array_position("o", F.array_max("o")) - 1).cast("int").alias("choice"), F.round(F.col("o")[0] + F.col("o")[1], 6).alias("true_mass"), F.round(total(F.slice("o", 3, 6)), 6).alias("false_mass"))


@query("SELECT p_partkey, string_agg(x, ',' ORDER BY sha256(p_partkey || ':' || x)) AS shuffled FROM (SELECT p_partkey, unnest([p_brand, p_type, 'size ' || p_size]) AS x FROM part) GROUP BY 1")
def option_shuffle(spark, sf):
    x = F.array("p_brand", "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    keyed = F.transform(x, lambda v: F.struct(F.sha2(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), v), 256), v.alias("v")))
    return read(spark, sf, "part").select("p_partkey", F.concat_ws(",", F.transform(F.sort_array(keyed), lambda s: s["v"])).alias("shuffled"))


@query("SELECT vec_id, count(*) FILTER (WHERE isnan(x) OR isinf(x)) AS bad FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def nonfinite_scan(spark, sf):
    bad = F.size(F.filter("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return read(spark, sf, "embeddings").select("vec_id", bad.cast("long").alias("bad"))


_L = "SELECT l.doc_id, d.lang, d.source, 1 - l.quality AS err, l.toxic, least(d.n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) AS score, d.n_chars FROM labels l JOIN documents d USING (doc_id)"


def _scored(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return read(spark, sf, "labels").join(d, "doc_id").select("doc_id", "lang", "source", (1 - F.col("quality")).alias("err"), "toxic", F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("score"), "n_chars")


_RANKED = f"SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS r FROM ({_L})"


@query(f"SELECT lang, count(*) AS n, sum(err)::BIGINT AS positives, round((sum(r * err) - sum(err) * (sum(err) + 1) / 2.0) / nullif(sum(err) * (count(*) - sum(err)), 0), 6) AS auroc, CASE WHEN least(sum(err), count(*) - sum(err)) < 20 THEN 'descriptive_only' WHEN least(sum(err), count(*) - sum(err)) < 50 THEN 'exploratory' WHEN least(sum(err), count(*) - sum(err)) < 100 THEN 'preliminary' ELSE 'suitable_for_primary_analysis' END AS reliability FROM ({_RANKED}) GROUP BY lang")
def auroc_by_language(spark, sf):
    out = metrics.auroc(_scored(spark, sf), "score", "err", ["lang"])
    return out.select("lang", "n", "positives", F.round("auroc", 6).alias("auroc"), metrics.reliability(F.least("positives", F.col("n") - F.col("positives"))).alias("reliability"))


@query(f"WITH c AS (SELECT lang, score, count(*) AS k, sum(err) AS p FROM ({_L}) GROUP BY ALL), s AS (SELECT *, sum(p) OVER w / sum(k) OVER w AS pr FROM c WINDOW w AS (PARTITION BY lang ORDER BY score DESC)) SELECT lang, round(sum(p * pr) / nullif(sum(p), 0), 6) AS average_precision FROM s GROUP BY lang")
def average_precision(spark, sf):
    return metrics.average_precision(_scored(spark, sf), "score", "err", ["lang"]).select("lang", F.round("average_precision", 6).alias("average_precision"))


_CURVE = f"SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY lang) AS n, sum(err) OVER w / row_number() OVER w AS risk FROM ({_L}) WINDOW w AS (PARTITION BY lang ORDER BY score, doc_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT lang, max(n) AS n, round(coalesce(sum((risk + b) / 2), 0) / max(n), 6) AS aurc, round(avg(risk), 6) AS mean_risk FROM (SELECT *, lag(risk) OVER (PARTITION BY lang ORDER BY rank) AS b FROM ({_CURVE})) GROUP BY lang")
def area_under_risk(spark, sf):
    curve = metrics.risk_curve(_scored(spark, sf), "score", "err", "doc_id", ["lang"])
    return metrics.aurc(curve, ["lang"], "doc_id").select("lang", "n", F.round("aurc", 6).alias("aurc"), F.round("mean_risk", 6).alias("mean_risk"))


@query(f"SELECT lang, rank AS rows_kept, round(risk, 6) AS risk FROM ({_CURVE}) WHERE rank IN (ceil(n * 0.2::DOUBLE), ceil(n * 0.5::DOUBLE), ceil(n * 0.8::DOUBLE), n)")
def risk_at_coverage(spark, sf):
    curve = metrics.risk_curve(_scored(spark, sf), "score", "err", "doc_id", ["lang"])
    kept = [F.ceil(F.col("n") * F.lit(t)) for t in (0.2, 0.5, 0.8, 1.0)]
    return curve.filter(F.col("rank").isin(*kept)).select("lang", F.col("rank").cast("long").alias("rows_kept"), F.round("risk", 6).alias("risk"))


@query(f"SELECT lang, round(coalesce(max(CASE WHEN risk <= 0.05 THEN rank END), 0) / max(n), 6) AS at5, round(coalesce(max(CASE WHEN risk <= 0.1 THEN rank END), 0) / max(n), 6) AS at10 FROM ({_CURVE}) GROUP BY lang")
def coverage_at_risk(spark, sf):
    curve = metrics.risk_curve(_scored(spark, sf), "score", "err", "doc_id", ["lang"])
    at = lambda r: F.round(F.coalesce(F.max(F.when(F.col("risk") <= r, F.col("rank"))), F.lit(0)) / F.max("n"), 6)
    return curve.groupBy("lang").agg(at(0.05).alias("at5"), at(0.1).alias("at10"))


_AUROC_BY = "SELECT lang, (sum(r * err) - sum(err) * (sum(err) + 1) / 2.0) / nullif(sum(err) * (count(*) - sum(err)), 0) AS a FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY {s}) + (count(*) OVER (PARTITION BY lang, {s}) - 1) / 2.0::DOUBLE AS r FROM ({l})) GROUP BY lang"


@query(f"""WITH c AS (SELECT d.lang, count(*) AS sample_count, count(*) FILTER (quality = 1) AS correct_count, count(*) FILTER (quality = 0) AS incorrect_count, count(*) FILTER (quality IS NULL) AS unresolved_count, count(*) FILTER (n_chars > 3000) AS truncation_count FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang)
SELECT c.lang, sample_count, correct_count, incorrect_count, unresolved_count, truncation_count, round(truncation_count / sample_count, 6) AS truncation_rate, round(a.a, 6) AS auroc, round(a.a - b.a, 6) AS auroc_gain, CASE WHEN a.a IS NULL THEN 'diagnostic_only' WHEN least(correct_count, incorrect_count) < 20 THEN 'descriptive_only' WHEN least(correct_count, incorrect_count) < 50 THEN 'exploratory' WHEN least(correct_count, incorrect_count) < 100 THEN 'preliminary' ELSE 'suitable_for_primary_analysis' END AS reliability_status
FROM c LEFT JOIN ({_AUROC_BY.format(s='score', l=_L)}) a ON c.lang IS NOT DISTINCT FROM a.lang LEFT JOIN ({_AUROC_BY.format(s='toxic', l=_L)}) b ON c.lang IS NOT DISTINCT FROM b.lang""")
def consolidated_metrics(spark, sf):
    """One row a language: verdicts, truncation, ranking metrics and the gain over another score."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "n_chars", (F.col("n_chars") > 3000).alias("cut"), F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("score"))
    rows = d.join(read(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("err"), "toxic"), "doc_id", "left")
    out = metrics.consolidated(rows, "lang", "doc_id", "err", "score", "toxic", "cut")
    return out.select("lang", "sample_count", "correct_count", "incorrect_count", "unresolved_count", "truncation_count", *(F.round(c, 6).alias(c) for c in ("truncation_rate", "auroc", "auroc_gain")), "reliability_status")


_CAL = f"SELECT lang, err::DOUBLE AS y, least(greatest(score, 1e-7::DOUBLE), 1.0::DOUBLE - 1e-7::DOUBLE) AS p FROM ({_L})"


@query(f"WITH c AS ({_CAL}), b AS (SELECT lang, least(floor(p * 10), 9) AS bin, count(*) AS k, sum((p - y) * (p - y)) AS s, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS l, abs(sum(p - y)) AS g FROM c GROUP BY ALL) SELECT lang, round(sum(s) / sum(k), 6) AS brier, round(sum(l) / sum(k), 6) AS nll, round(sum(g) / sum(k), 6) AS ece FROM b GROUP BY lang")
def calibration_summary(spark, sf):
    out = metrics.calibration(_scored(spark, sf), "score", "err", ["lang"])
    return out.select("lang", *(F.round(c, 6).alias(c) for c in ("brier", "nll", "ece")))


@query(f"WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY lang ORDER BY err) + (count(*) OVER (PARTITION BY lang, err) - 1) / 2.0::DOUBLE AS b FROM ({_L})) SELECT lang, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) END AS spearman FROM r GROUP BY lang")
def rank_correlation(spark, sf):
    return metrics.spearman(_scored(spark, sf), "n_chars", "err", ["lang"]).select("lang", F.round("spearman", 6).alias("spearman"))


_WEIGHT = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in resamples.POISSON)
_BOOT = f"""WITH l AS ({_L}), r AS MATERIALIZED (SELECT *, {_WEIGHT} AS w FROM (SELECT l.*, d, ('0x' || substr(md5('boot:' || d // 4 || ':' || doc_id), 8 * (d % 4) + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l, range(200) a(d)))"""


def auroc_draws_sql(score: str) -> str:
    counts = f"SELECT d, {score} AS s, sum(w) AS k, sum(w * err) AS p FROM r WHERE w > 0 GROUP BY 1, 2"
    ranks = f"SELECT *, sum(k) OVER (PARTITION BY d ORDER BY s) - (k - 1) / 2.0::DOUBLE AS rk FROM ({counts})"
    return f"SELECT d, (sum(rk * p) - sum(p) * (sum(p) + 1) / 2.0::DOUBLE) / nullif(sum(p) * (sum(k) - sum(p)), 0) AS v FROM ({ranks}) GROUP BY d"


@query(_BOOT + ", m AS (SELECT d, sum(w * err) / sum(w) AS mean FROM r WHERE w > 0 GROUP BY d) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, round(avg(mean), 6) AS mean, count(*) AS draws FROM m")
def bootstrap_interval(spark, sf):
    out = resamples.interval(resamples.bootstrap(_scored(spark, sf), "doc_id", 200, "boot", resamples.mean("err")))
    return out.select(*(F.round(c, 6).alias(c) for c in ("low", "high", "mean")), "draws")


@query(_BOOT + f", m AS ({auroc_draws_sql('score')}) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS draws, count(v) AS valid FROM m")
def bootstrap_auroc(spark, sf):
    out = resamples.interval(resamples.bootstrap(_scored(spark, sf), "doc_id", 200, "boot", resamples.auroc("score", "err")))
    return out.select(*(F.round(c, 6).alias(c) for c in ("low", "high")), "draws", "valid")


@query(_BOOT + f", a AS ({auroc_draws_sql('score')}), b AS ({auroc_draws_sql('toxic')}), m AS (SELECT d, b.v - a.v AS gap, a.v - a.v AS same FROM a JOIN b USING (d)) SELECT round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high, max(abs(same)) AS same, count(*) AS draws, count(gap) AS valid FROM m")
def paired_bootstrap(spark, sf):
    """Two scores on the same resamples; a score against itself differs by exactly 0."""
    rows, a, b = _scored(spark, sf), resamples.auroc("score", "err"), resamples.auroc("toxic", "err")
    gap = resamples.interval(resamples.paired(rows, "doc_id", 200, "boot", a, b))
    same = resamples.paired(rows, "doc_id", 200, "boot", a, a).agg(F.max(F.abs("value")).alias("same"))
    return gap.crossJoin(same).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "same", "draws", "valid")  # one row each


@query(f"SELECT doc_id, lang, n_chars FROM (SELECT *, quantile_cont(score, 0.25) OVER (PARTITION BY lang) AS q FROM ({_L})) WHERE err = 1 AND score <= q")
def confident_errors(spark, sf):
    rows = _scored(spark, sf)
    cut = rows.groupBy("lang").agg(F.percentile("score", 0.25).alias("q"))
    return rows.join(cut, "lang").filter("err = 1 AND score <= q").select("doc_id", "lang", "n_chars")


@query("SELECT o_orderkey, round(o_totalprice - (regr_slope(o_totalprice, o_custkey) OVER () * o_custkey + regr_intercept(o_totalprice, o_custkey) OVER ()), 2) AS residual FROM orders")
def linear_residuals(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return learners.residuals(rows, rows, ["o_custkey"], "o_totalprice", alpha=0.0).select("o_orderkey", F.round("residual", 2).alias("residual"))
