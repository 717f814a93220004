"""Ranking, calibration and selective-prediction metrics; a higher score means more risk of label 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running
from .sampling import ranked

CLIP = 1e-7


def average_ranks(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Rank with ties averaged: a count per distinct value, then a running sum over those; rows without a value are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    ranks = running(counts, by, [value], {"_up": F.col("_k")})
    ranks = ranks.select(*(F.col(c).alias(f"_of_{c}") for c in [*by, value]), (F.col("_up") - (F.col("_k") - 1) / 2.0).alias(out))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return df.join(ranks, [*same, F.col(value) == F.col(f"_of_{value}")]).drop(*(f"_of_{c}" for c in [*by, value]))


def auroc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Mann-Whitney form on counts per distinct score; null where a class is missing."""
    counts = df.groupBy(*by, score).agg(F.count("*").alias("k"), F.sum(label).alias("pos"))
    up = running(counts, by, [score], {"_up": F.col("k")})
    sums = up.withColumn("r", F.col("_up") - (F.col("k") - 1) / 2.0).groupBy(*by).agg(F.sum("k").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("r") * F.col("pos")).alias("s"))
    value = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p")))
    return sums.select(*by, "n", F.col("p").cast("long").alias("positives"), F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), value).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Precision at each distinct score, weighted by its positives; what is at or above a score is all but what is below it."""
    counts = df.groupBy(*by, score).agg(F.count("*").alias("k"), F.sum(label).alias("pos"))
    up = running(counts, by, [score], {"_k": F.col("k"), "_p": F.col("pos")}, {"_n": F.col("k"), "_all": F.col("pos")})
    precision = (F.col("_all") - F.col("_p") + F.col("pos")) / (F.col("_n") - F.col("_k") + F.col("k"))
    return up.groupBy(*by).agg((F.sum(F.col("pos") * precision) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def risk_curve(df: DataFrame, score: str, label: str, key: str, by: list[str]) -> DataFrame:
    """Rank, rows and cumulative risk by rising score, ties by ``key``; ranges of scores are worked on apart."""
    rows = ranked(df.select(*by, key, score, label), score, key, by, total=label)
    return rows.select(*by, key, score, label, "rank", "n", (F.col("so_far") / F.col("rank")).alias("risk"))


def aurc(curve: DataFrame, by: list[str], key: str) -> DataFrame:
    """Trapezoid area under a risk curve from coverage 1/n to 1, all risks less half of the first and the last, and their mean."""
    ends = F.max(F.when(F.col("rank") == 1, F.col("risk"))) + F.max(F.when(F.col("rank") == F.col("n"), F.col("risk")))
    return curve.groupBy(*by).agg(F.max("n").alias("n"), ((F.sum("risk") - ends / 2.0) / F.max("n")).alias("aurc"), F.avg("risk").alias("mean_risk"))


def calibration(df: DataFrame, score: str, label: str, by: list[str], bins: int = 10) -> DataFrame:
    """Brier score, negative log-likelihood and expected calibration error of clipped probabilities."""
    p = F.least(F.greatest(F.col(score), F.lit(CLIP)), F.lit(1 - CLIP))
    rows = df.select(*by, p.alias("p"), F.col(label).cast("double").alias("y")).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    ll = -(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))
    per = rows.groupBy(*by, "bin").agg(F.count("*").alias("k"), F.sum((F.col("p") - F.col("y")) ** 2).alias("b"), F.sum(ll).alias("l"), F.abs(F.sum(F.col("p") - F.col("y"))).alias("g"))
    n = F.sum("k")
    return per.groupBy(*by).agg((F.sum("b") / n).alias("brier"), (F.sum("l") / n).alias("nll"), (F.sum("g") / n).alias("ece"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks; null under three rows or where a side is constant."""
    ranked = average_ranks(average_ranks(df.select(*by, x, y), x, by, "rx"), y, by, "ry")
    ok = (F.count("*") >= 3) & (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    value = F.covar_pop("rx", "ry") / F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0))
    return ranked.groupBy(*by).agg(F.when(ok, value).alias("spearman"))


def reliability(minority):
    """How far a result can be trusted by the size of its smaller class. The names are fixed values."""
    return F.when(minority < 20, "descriptive_only").when(minority < 50, "exploratory").when(minority < 100, "preliminary").otherwise("suitable_for_primary_analysis")


def mean_risk(curve: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the cumulative risk over all ranks."""
    return curve.groupBy(*by).agg(F.avg("risk").alias("mean_risk"))


def gains(values: DataFrame, by: list[str], name: str, value: str, baseline: str) -> DataFrame:
    """(by, name, value, gain) against the row of the baseline; null where either is."""
    base = values.filter(F.col(name) == baseline).select(*by, F.col(value).alias("_b"))
    out = values.join(base, by, "left") if by else values.crossJoin(base)  # one row
    return out.select(*by, name, value, (F.col(value) - F.col("_b")).alias("gain"))


def consolidated(df: DataFrame, dataset: str, key: str, label: str, score: str, baseline: str, truncated: str) -> DataFrame:
    """One row a dataset: counts by verdict (null is unresolved), truncation, ranking metrics of ``score`` and its gain over ``baseline``.

    A dataset without both classes has null metrics and is ``diagnostic_only``.
    """
    n = F.count("*")
    counts = df.groupBy(dataset).agg(n.alias("sample_count"), F.count_if(F.col(label) == 0).alias("correct_count"), F.count_if(F.col(label) == 1).alias("incorrect_count"), F.count_if(F.col(label).isNull()).alias("unresolved_count"), F.count_if(truncated).alias("truncation_count"), (F.count_if(truncated) / n).alias("truncation_rate"))
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & F.col(baseline).isNotNull())
    first = auroc(known, score, label, [dataset]).select(dataset, "n", "positives", "auroc")
    base = auroc(known, baseline, label, [dataset]).select(dataset, F.col("auroc").alias("_base"))
    area = aurc(risk_curve(known, score, label, key, [dataset]), [dataset], key).select(dataset, "aurc")
    out = counts.join(first, dataset, "left").join(base, dataset, "left").join(average_precision(known, score, label, [dataset]), dataset, "left").join(area, dataset, "left")
    there = F.col("auroc").isNotNull()
    status = F.when(there, reliability(F.least("positives", F.col("n") - F.col("positives")))).otherwise("diagnostic_only")
    return out.select(*counts.columns, "auroc", F.when(there, F.col("average_precision")).alias("auprc"), F.when(there, F.col("aurc")).alias("aurc"), status.alias("reliability_status"), (F.col("auroc") - F.col("_base")).alias("auroc_gain"))
