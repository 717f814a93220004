"""Registered queries on learners: residuals, out-of-fold scores, comparisons of families, transfer and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import learners, metrics, resamples, sampling
from ..operators.learners import Design
from ..sources.shared import kept
from .table_queries import _FOLD
from .text_queries import read
from .value_queries import _L, _scored

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Families of the stand-in features of a document: length, words, shape and repetition.
FAMILIES = {"L": ["n_chars"], "W": ["n_words", "mean_word"], "S": ["n_lines", "upper"], "R": ["repeated", "digits"]}
NAMES = ["L", "W", "L+W", "S", "L+S", "L+W+S", "R", "L+R", "L+W+R", "L+W~S", "L+W~R"]
DEPTHS = [*NAMES, "S+R", "W+S", "W+R", "W+S+R", "L+W+S+R"]
TRANSFERS = ["L", "W", "S", "R", "L+W+S", "L+W+R", "L+W~S", "L+W~R"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(x):
    return F.round(x, 6)


def featured(spark, sf):
    """Labelled documents with the features of all families."""
    few = read(spark, sf, "documents").filter("text is not null").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    d = few.select("doc_id", F.col("text").alias("t"), T.tokens(F.col("text")).alias("w"))
    count = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    x = d.select("doc_id", F.size("w").alias("n_words"), (F.length("t") / F.greatest(F.size("w"), F.lit(1))).alias("mean_word"), count("\\n").alias("n_lines"), count("[A-Z]").alias("upper"), T.repetition(F.col("w")).alias("repeated"), count("[0-9]").alias("digits"))
    return kept(_scored(spark, sf).join(x, "doc_id"))  # texts are read once, however often the features are


def folded(spark, sf, seed: str = "2026"):
    return sampling.folds(featured(spark, sf), "err", "lang", "doc_id", 5, seed)


@query(f"""WITH f AS (SELECT *, doc_id % 5 AS fold FROM ({_L})), m AS (SELECT avg(n_chars) AS mx, avg(score) AS my, regr_sxy(score, n_chars) / regr_sxx(score, n_chars) * count(*) / (count(*) + 1.0::DOUBLE) AS b FROM f WHERE fold <> 0)
SELECT doc_id, round(score - (my + b * (n_chars - mx)), 6) AS residual FROM f, m WHERE fold = 0""")
def ridge_residuals(spark, sf):
    """What length doesn't explain, by a ridge fitted on the other folds."""
    rows = _scored(spark, sf).withColumn("fold", F.col("doc_id") % 5)
    return learners.residuals(rows.filter("fold = 0"), rows.filter("fold <> 0"), ["n_chars"], "score").select("doc_id", r6(F.col("residual")).alias("residual"))


def logistic_sql(rows: str, models: str, train: str, test: str) -> str:
    """Balanced L2 logistic regressions (C = 1) on one standardised feature by 20 steps of Newton's method.

    ``rows(id, f, x, y)``, ``models(k)``, and which rows (``d``) train and test a model (``m.k``); gives (id, k, y, score).
    """
    slope, level = "(gw * hbb - gb * hwb) / (hww * hbb - hwb * hwb)", "(gb * hww - gw * hwb) / (hww * hbb - hwb * hwb)"
    return f"""WITH RECURSIVE d AS MATERIALIZED ({rows}), k AS MATERIALIZED ({models}),
m AS MATERIALIZED (SELECT m.k, avg(x) AS mx, stddev_pop(x) AS sx, count(*) / (2.0::DOUBLE * sum(y)) AS c1, count(*) / (2.0::DOUBLE * (count(*) - sum(y))) AS c0 FROM k m, d WHERE {train} GROUP BY m.k),
z AS MATERIALIZED (SELECT m.k, (x - mx) / sx AS z, y, CASE WHEN y = 1 THEN c1 ELSE c0 END AS c FROM m, d WHERE {train}),
s(it, k, w, b) AS (SELECT 0, k, 0.0::DOUBLE, 0.0::DOUBLE FROM k UNION ALL SELECT it + 1, k, w - {slope}, b - {level} FROM (
SELECT it, k, w, b, sum(c * (p - y) * z) + w AS gw, sum(c * (p - y)) AS gb, sum(c * p * (1 - p) * z * z) + 1 AS hww, sum(c * p * (1 - p) * z) AS hwb, sum(c * p * (1 - p)) AS hbb
FROM (SELECT s.it, s.k, s.w, s.b, z.z, z.y, z.c, 1 / (1 + exp(-(s.w * z.z + s.b))) AS p FROM s JOIN z ON z.k = s.k WHERE it < 20) GROUP BY 1, 2, 3, 4))
SELECT id, m.k, y, 1 / (1 + exp(-(w * (x - mx) / sx + b))) AS score FROM d JOIN m ON {test} JOIN s ON s.k = m.k WHERE it = 20"""


_FOLDED = _FOLD + " SELECT doc_id AS id, fold AS f, n_chars::DOUBLE AS x, (1 - f.quality)::DOUBLE AS y FROM f JOIN documents USING (doc_id)"


@query(f"SELECT id AS doc_id, k AS fold, y::INT AS err, round(score, 6) AS score FROM ({logistic_sql(_FOLDED, 'SELECT DISTINCT f AS k FROM d', 'd.f <> m.k', 'd.f = m.k')})")
def length_out_of_fold(spark, sf):
    """Scores by length alone, from models that never saw the row's fold."""
    rows = sampling.folds(_scored(spark, sf), "err", "lang", "doc_id", 5, "2026")
    return learners.out_of_fold(rows, "doc_id", "err", ["n_chars"]).withColumn("score", r6(F.col("score")))


@query(f"""WITH s AS ({logistic_sql(_FOLDED, 'SELECT DISTINCT f AS k FROM d', 'd.f <> m.k', 'd.f = m.k')}), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s),
c AS (SELECT y, least(greatest(score, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p FROM s) SELECT (SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 5) FROM r) AS auroc, (SELECT round(avg((p - y) * (p - y)), 5) FROM c) AS brier, (SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 5) FROM c) AS nll""")
def length_metrics(spark, sf):
    """The metric bundle of the scores by length."""
    rows = sampling.folds(_scored(spark, sf), "err", "lang", "doc_id", 5, "2026")
    out = learners.bundle(learners.out_of_fold(rows, "doc_id", "err", ["n_chars"]).withColumn("all", F.lit(0)), "doc_id", "err", ["all"])
    return out.select(*(F.round(c, 5).alias(c) for c in ("auroc", "brier", "nll")))


@query(f"SELECT id AS doc_id, y::INT AS err, round(score, 6) AS score FROM ({logistic_sql(f'SELECT doc_id AS id, lang AS f, n_chars::DOUBLE AS x, err::DOUBLE AS y FROM ({_L})', 'SELECT ' + chr(39) + 'en' + chr(39) + ' AS k', 'd.f = m.k', 'd.f <> m.k')})")
def length_transfer(spark, sf):
    """A model by length of English documents, applied to the others without a refit."""
    out = learners.transferred(_scored(spark, sf), {"length": Design(["n_chars"])}, "doc_id", "err", "lang", "en")
    return out.select("doc_id", "err", r6(F.col("score")).alias("score"))


@query()
def logistic_out_of_fold(spark, sf):
    return learners.out_of_fold(folded(spark, sf), "doc_id", "err", ["n_chars", "n_words", "n_lines"]).withColumn("score", r6(F.col("score")))


SMALL = ["n_chars", "n_words", "n_lines"]


@query()
def nested_regularisation(spark, sf):
    """Scores with the strength that inner folds of each fold's training rows prefer."""
    scored, models = learners.compared(featured(spark, sf), {"small": Design(SMALL)}, "doc_id", "err", "lang")
    strengths = F.create_map(*(F.lit(v) for m in models for v in (int(m.name.split("|")[2]), m.c)))
    return scored.select("doc_id", "fold", "err", r6(F.col("score")).alias("score"), strengths[F.col("fold")].alias("c"))


def details_of(spark, models, comparisons):
    rows = [(*r[:7], {k: round(v, 6) for k, v in r[7].items()}) for r in learners.fold_details(models, comparisons)]
    return spark.createDataFrame(rows, "comparison string, seed string, fold int, strength double, train_rows int, train_errors int, constant_inputs int, weights map<string, double>")


@query()
def fold_details(spark, sf):
    """Of each fold's model: its strength, training rows by class, constant inputs left out and the weights of the others."""
    comparisons = learners.designs(FAMILIES, ["L+W+S", "L+W~R"], "L+W") | {"with a constant": Design([*SMALL, "always"])}
    rows = featured(spark, sf).withColumn("always", F.lit(1.0))
    _, models = learners.compared(rows, comparisons, "doc_id", "err", "lang")
    out = details_of(spark, models, comparisons)
    weights = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("weights")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return out.withColumn("weights", weights)


METRICS = ("auroc", "average_precision", "aurc", "brier", "nll", "ece")


def _bundled(scored, by=("comparison",)):
    rows = kept(learners.averaged(scored, "doc_id", "err"))  # read for each metric
    return learners.bundle(rows, "doc_id", "err", list(by)).withColumns({c: r6(F.col(c)) for c in METRICS})


SEEDS = tuple(str(s) for s in range(2026, 2036))


@query()
def family_comparisons(spark, sf):
    """Eleven comparisons of families, two of them on what length and words don't explain: metrics on one split, the range over ten, and the rank of the features."""
    rows, comparisons = featured(spark, sf), learners.designs(FAMILIES, NAMES, "L+W")
    dealt, whole, models = learners.fitted(rows, comparisons, "doc_id", "err", "lang", SEEDS)
    first = _bundled(learners.scored_by(dealt, whole, "doc_id", "err", [m for m in models if m.name.split("|")[1] == SEEDS[0]]))
    parts = learners.split_aurocs(dealt, whole, "err", models)
    spread = parts.groupBy("comparison").agg(r6(F.min("auroc")).alias("auroc_low"), r6(F.max("auroc")).alias("auroc_high"), F.count("auroc").alias("splits"))
    columns = {name: [c.lstrip("~") for c in d.all] for name, d in comparisons.items()}
    found = learners.ranks(rows, columns)
    report = spark.createDataFrame([(name, len(c), found[name], found[name] < len(c)) for name, c in columns.items()], "comparison string, features int, matrix_rank int, rank_deficient boolean")
    return first.join(spread, "comparison").join(report, "comparison")


@query()
def feature_ablation(spark, sf):
    """Four families, scores averaged over five splits."""
    scored, _ = learners.compared(featured(spark, sf), learners.designs(FAMILIES, ["L+W", "L+W+S", "L+W+R", "L+W+S+R"]), "doc_id", "err", "lang", SEEDS[:5])
    return _bundled(scored)


@query()
def depth_ablation(spark, sf):
    """Sixteen sets of families with their gain over length and words."""
    scored, _ = learners.compared(featured(spark, sf), learners.designs(FAMILIES, DEPTHS, "L+W"), "doc_id", "err", "lang")
    out = _bundled(scored).select("comparison", "auroc", "aurc")
    return metrics.gains(out, [], "comparison", "auroc", "L+W").withColumn("gain", r6(F.col("gain")))


@query()
def transfer(spark, sf):
    """Trained on English documents with a strength chosen there, scored on the other languages without a refit, by eight sets of features."""
    rows = featured(spark, sf).withColumn("target", (F.col("lang") != "en").cast("int"))
    scored, _ = learners.compared(rows, learners.designs(FAMILIES, TRANSFERS, "L+W"), "doc_id", "err", None, ("all",), 2, fold="target", only=(1,))
    out = scored.filter("score is not null").join(rows.select("doc_id", "lang"), "doc_id")
    return metrics.auroc(out, "score", "err", ["comparison", "lang"]).withColumn("auroc", r6(F.col("auroc")))


@query()
def group_protocols(spark, sf):
    """With indicators of the language, within each language alone, and with each language left out; strengths chosen within each fold."""
    from ..functions.features import one_hot

    rows = featured(spark, sf)
    hot = one_hot(rows.withColumn("level", F.col("lang")), "level", "lang_").withColumn("lang_all", F.lit("all"))
    levels = [c for c in hot.columns if c.startswith("lang_") and c != "lang_all"]
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())  # four
    number = F.create_map(*(F.lit(x) for i, g in enumerate(languages) for x in (g, i)))
    pick = lambda scored, protocol, lang: scored.select(F.lit(protocol).alias("protocol"), lang.alias("lang"), "doc_id", "err", "score")
    controlled, _ = learners.compared(hot, {"all": Design([*SMALL, *levels])}, "doc_id", "err", "lang")
    scored = pick(controlled, "controlled", F.lit("all"))
    left, _ = learners.compared(rows.withColumn("group", number[F.col("lang")]), {"all": Design(SMALL)}, "doc_id", "err", None, ("all",), len(languages), fold="group")
    scored = scored.unionByName(pick(left, "left out", F.get(F.array(*map(F.lit, languages)), F.col("fold"))))
    for g in languages:
        own, _ = learners.compared(rows.filter(F.col("lang") == g), {"all": Design(SMALL)}, "doc_id", "err", None)
        scored = scored.unionByName(pick(own, "own", F.lit(g)))
    return metrics.auroc(kept(scored.filter("score is not null")), "score", "err", ["protocol", "lang"]).withColumn("auroc", r6(F.col("auroc")))


@query()
def coefficient_stability(spark, sf):
    """Weights over folds and seeds, each fold with its own strength: mean, deviation and how often they are above zero."""
    design = Design([*SMALL, "upper"])
    _, models = learners.compared(featured(spark, sf), {"all": design}, "doc_id", "err", "lang", SEEDS[:3])
    return spark.createDataFrame([(f, round(a, 6), round(b, 6), c) for f, a, b, c in learners.stability(models, design.all)], "feature string, mean double, deviation double, positive double")


@query()
def stability_audit(spark, sf):
    """AUROC of twelve sets of families over ten splits: mean and range."""
    rows, whole, models = learners.fitted(featured(spark, sf), learners.designs(FAMILIES, DEPTHS[:12], "L+W"), "doc_id", "err", "lang", SEEDS)
    parts = learners.split_aurocs(rows, whole, "err", models)
    return parts.groupBy("comparison").agg(r6(F.avg("auroc")).alias("mean"), r6(F.max("auroc") - F.min("auroc")).alias("spread"), F.count("*").alias("splits"))


@query()
def target_analysis(spark, sf):
    """The same features against several targets, with the interval of the gain of the larger set."""
    rows, out = featured(spark, sf).withColumn("any_error", F.greatest("err", "toxic")), None
    for target in ("err", "toxic", "any_error"):
        base = rows.select("doc_id", "lang", F.col(target).alias("y"), *(c for f in FAMILIES.values() for c in f))
        scored, _ = learners.compared(base, learners.designs(FAMILIES, ["L", "L+W+S+R"]), "doc_id", "y", "lang")
        wide = kept(scored.groupBy("doc_id", "y").pivot("comparison", ["L", "L+W+S+R"]).agg(F.first("score")).toDF("doc_id", "y", "small", "large").dropna())
        gap = resamples.interval(resamples.paired(wide, "doc_id", 200, target, resamples.auroc("small", "y"), resamples.auroc("large", "y")))
        part = gap.select(F.lit(target).alias("target"), r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), r6(F.col("mean")).alias("gain"), "draws", "valid")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def experiment_summary(spark, sf):
    """One row a language: counts, class balance, metrics of out-of-fold scores and their reliability."""
    rows = folded(spark, sf)
    scored = learners.out_of_fold(rows, "doc_id", "err", ["n_chars", "n_words", "n_lines"]).join(rows.select("doc_id", "lang", "n_chars"), "doc_id")
    counts = rows.groupBy("lang").agg(F.count("*").alias("records"), r6(F.avg("err")).alias("error_rate"), F.percentile("n_chars", 0.5).alias("median_chars"))
    out = learners.bundle(scored, "doc_id", "err", ["lang"])
    return counts.join(out, "lang", "left").withColumns({c: r6(F.col(c)) for c in ("auroc", "average_precision", "aurc", "brier", "nll", "ece")})


@query()
def audit_summary(spark, sf):
    """The whole audit of a collection in one row a language: gate, balance, risk at coverage and rank correlation."""
    rows = _scored(spark, sf)
    curve = metrics.risk_curve(rows, "score", "err", "doc_id", ["lang"])
    at = curve.groupBy("lang").agg(*(r6(F.max(F.when(F.col("rank") == F.ceil(F.col("n") * F.lit(c)), F.col("risk")))).alias(f"risk_at_{int(100 * c)}") for c in (0.2, 0.5, 0.8, 1.0)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("err").alias("wrong"))
    gate = counts.withColumn("gate", metrics.reliability(F.least("wrong", F.col("n") - F.col("wrong"))))
    return gate.join(at, "lang").join(metrics.spearman(rows, "n_chars", "err", ["lang"]).withColumn("spearman", r6(F.col("spearman"))), "lang")


@query("SELECT count(*) FILTER (WHERE v > 0)::INT AS rank, count(*) FILTER (WHERE v > 0) > 0 AS finite FROM (SELECT unnest([q, t, b]) AS v FROM (SELECT stddev_pop(l_quantity) AS q, stddev_pop(l_tax) AS t, max(abs(l_quantity + 2 * l_tax - \"both\")) AS b FROM (SELECT l_quantity, l_tax, l_quantity + 2 * l_tax AS \"both\" FROM lineitem)))")
def matrix_rank(spark, sf):
    """Rank of columns of which one is the sum of two others, and whether their condition is finite; the SQL counts those that vary and aren't such a sum."""
    x = read(spark, sf, "lineitem").select("l_quantity", "l_tax", (F.col("l_quantity") + 2 * F.col("l_tax")).alias("both"))
    rank, condition = learners.rank_and_condition(x, ["l_quantity", "l_tax", "both"])
    return spark.createDataFrame([(rank, condition < float("inf"))], "rank int, finite boolean")


@query("WITH r AS (SELECT o_orderkey, o_totalprice, o_totalprice - (regr_slope(o_totalprice, o_custkey) OVER () * o_custkey + regr_intercept(o_totalprice, o_custkey) OVER ()) AS e FROM orders), k AS (SELECT rank() OVER (ORDER BY round(e, 4)) + (count(*) OVER (PARTITION BY round(e, 4)) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS b FROM r) SELECT round(corr(a, b), 5) AS spearman FROM k")
def residual_correlation(spark, sf):
    """Rank correlation of a residual with what it is a residual of."""
    rows = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    left = learners.residuals(rows, rows, ["o_custkey"], "o_totalprice", alpha=0.0).withColumn("residual", F.round("residual", 4)).withColumn("all", F.lit(0))
    return metrics.spearman(left, "residual", "o_totalprice", ["all"]).select(F.round("spearman", 5).alias("spearman"))
