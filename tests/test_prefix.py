"""Running sums, ranks and resamples by ranges: against serial computation, with one group, one value and hot values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import metrics, resamples, sampling
from gradeflow.operators.prefix import range_of, running


def table(spark, rows, schema="id long, g string, v double, y int"):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "a", "b", "b", "b"]), rng.choice([None, 0.0, 1.0, 1.0, 1.0, rng.random(), float("inf")]), rng.randrange(2)) for i in range(900)]
    return table(spark, rows), rows


def order(r):
    return (r[2] is not None, r[2] or 0.0, r[0])


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums(mixed, by, ranges):
    df, rows = mixed
    got = {r["id"]: (r["place"], r["sum"], r["n"], r["all"]) for r in running(df, by, ["v", "id"], {"place": F.lit(1), "sum": F.col("y")}, {"n": F.lit(1), "all": F.col("y")}, ranges).collect()}
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r[1] if by else 0, []).append(r)
    for part in groups.values():
        total = 0
        for i, r in enumerate(part):
            total += r[3]
            assert got[r[0]] == (i + 1, total, len(part), sum(x[3] for x in part))


def test_running_sums_of_nothing(mixed):
    df, _ = mixed
    assert running(df.filter("false"), ["g"], ["v", "id"], {"x": F.lit(1)}).count() == running(df.filter("false"), [], ["v", "id"], {"x": F.lit(1)}).count() == 0


@pytest.mark.parametrize("hot", [0.5, 1.0])
def test_a_hot_value_lies_in_many_ranges(spark, hot):
    df = spark.range(40_000).select("id", F.when(F.col("id") % 100 < 100 * hot, 7.0).otherwise(F.rand(3)).alias("v"))
    sizes = [r["count"] for r in df.withColumn("r", range_of(df, ["v", "id"], 32)).groupBy("r").count().collect()]
    assert len(sizes) >= 30 and max(sizes) < 4 * 40_000 / 32


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_even_without_groups(mixed):
    df, _ = mixed
    one = df.withColumn("all", F.lit(0))
    for by in ([], ["all"]):
        source = df if not by else one
        for out in (metrics.average_ranks(source, "v", by), sampling.ranked(source, "v", "id", by), running(source, by, ["v", "id"], {"x": F.lit(1)})):
            windows = [x for x in plan_of(out).splitlines() if "Window [" in x]
            assert windows and all("_range" in x or "_b_v" in x for x in windows)
    assert "SinglePartition" not in plan_of(sampling.ranked(df, "v", "id"))


def brute_auroc(s, y, w=None):
    s, y = np.array(s), np.array(y)
    w = np.ones(len(s)) if w is None else w
    pos, neg = y == 1, y == 0
    wins = ((s[pos][:, None] > s[neg][None]) + 0.5 * (s[pos][:, None] == s[neg][None])) * w[pos][:, None] * w[neg][None]
    pairs = w[pos].sum() * w[neg].sum()
    return wins.sum() / pairs if pairs else None


@pytest.mark.parametrize("values", [lambda r: r.random(), lambda r: float(r.randrange(4)), lambda r: 3.0, lambda r: r.choice([5.0] * 5 + [r.random() * 9])])
def test_metrics_of_one_group(spark, values):
    rng = random.Random(8)
    rows = [(i, "one", values(rng), int(rng.random() < 0.3)) for i in range(700)]
    df = table(spark, rows)
    s, y = [r[2] for r in rows], [r[3] for r in rows]
    assert metrics.auroc(df, "v", "y", ["g"]).first()["auroc"] == pytest.approx(brute_auroc(s, y))
    assert metrics.auroc(df.withColumn("y", F.lit(1)), "v", "y", ["g"]).first()["auroc"] is None
    expected = sum(sum(y[i] for i in range(700) if s[i] == t) / sum(y) * sum(y[i] for i in range(700) if s[i] >= t) / sum(x >= t for x in s) for t in set(s))
    assert metrics.average_precision(df, "v", "y", ["g"]).first()["average_precision"] == pytest.approx(expected)
    ranks = {r["id"]: r["rank"] for r in metrics.average_ranks(df, "v", ["g"]).collect()}
    assert all(ranks[r[0]] == sum(x < r[2] for x in s) + (sum(x == r[2] for x in s) + 1) / 2 for r in rows)
    for ranges in (1, 9):
        got = resamples.auroc("v", "y", ranges)(df, "id", 10, "seed")
        w = resamples.weights([str(i) for i in range(700)], 10, "seed")
        assert got == pytest.approx([brute_auroc(s, y, w[:, d]) for d in range(10)])


def test_resampled_means(spark):
    rows = [(i, "g", None if i % 50 == 0 else float(i % 7), 0) for i in range(3000)]
    got = resamples.mean("v")(table(spark, rows), "id", 37, "x")
    used = [r for r in rows if r[2] is not None]
    w = resamples.weights([str(r[0]) for r in used], 37, "x")
    assert got == pytest.approx((np.array([r[2] for r in used]) @ w / w.sum(0)).tolist())
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1
    assert resamples.mean("v")(table(spark, rows).filter("false"), "id", 3, "x") == [None] * 3


def test_paired_resamples(spark):
    rows = spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 5)) for i in range(200)], "id long, y int, s double, t double")
    a, b = resamples.auroc("s", "y"), resamples.auroc("t", "y")
    same = resamples.paired(rows, "id", 100, "x", a, a)
    assert same.count() == 100 and same.agg(F.max(F.abs("value")).alias("m")).first()["m"] == 0.0
    gap = resamples.interval(resamples.paired(rows, "id", 100, "x", a, b)).first()
    assert gap["valid"] == 100 and gap["low"] <= gap["mean"] <= gap["high"]
    w = resamples.weights([str(i) for i in range(200)], 100, "x")
    each = [brute_auroc([i % 5 for i in range(200)], [i % 2 for i in range(200)], w[:, d]) - brute_auroc([i % 7 for i in range(200)], [i % 2 for i in range(200)], w[:, d]) for d in range(100)]
    assert gap["mean"] == pytest.approx(np.mean(each)) and gap["low"] == pytest.approx(np.quantile(each, 0.025))
    one_class = resamples.bootstrap(rows.withColumn("y", F.lit(1)), "id", 20, "x", a)
    assert one_class.filter("value is not null").count() == 0 and one_class.count() == 20
    assert math.isclose(sum(resamples.POISSON[i] - (resamples.POISSON[i - 1] if i else 0) for i in range(10)), 1, abs_tol=1e-6)
