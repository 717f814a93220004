"""Comparisons of families, chosen strengths and protocols against numpy on the queries' own rows."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import learners
from gradeflow.operators.learners import Design
from gradeflow.plans import learner_queries as Q

from .test_operators import newton
from .test_prefix import brute_auroc

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def md5(*x):
    return hashlib.md5(":".join(map(str, x)).encode()).hexdigest()


def folds_of(rows, label, stratum, key, k, seed):
    """Round robin by class, then stratum, then hash: serially."""
    out, at = {}, defaultdict(int)
    for r in sorted(rows, key=lambda r: (r[label], r[stratum] if stratum else 0, md5(seed, r[key]), r[key])):
        out[r[key]] = at[r[label]] % k
        at[r[label]] += 1
    return out


def inner_of(rows, label, key, seed):
    """Inner folds of training rows, by class in hash order; None where a class has fewer than two."""
    counts = Counter(r[label] for r in rows)
    n = min([3, *counts.values()]) if len(counts) > 1 else 0
    out, at = {}, defaultdict(int)
    for r in sorted(rows, key=lambda r: (md5(f"inner{seed}", r[key]), r[key])):
        out[r[key]] = at[r[label]] % n if n > 1 else None
        at[r[label]] += 1
    return out


def matrix(rows, columns):
    return np.array([[float(r[c]) for c in columns] for r in rows]).reshape(len(rows), len(columns))


def inputs(train, test, d):
    """Features, and residual ones by a ridge of the training rows."""
    a, b = matrix(train, d.features), matrix(test, d.features)
    if d.residual:
        x, y = matrix(train, d.controls), matrix(train, d.residual)
        m, s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        z = (x - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(len(m)), z.T @ (y - y.mean(0)))
        a = np.hstack([a, y - y.mean(0) - z @ w])
        b = np.hstack([b, matrix(test, d.residual) - y.mean(0) - (matrix(test, d.controls) - m) / s @ w])
    return a, b


def fitted(x, y, test, c):
    free = np.ptp(x, axis=0) > 1e-12
    if not free.any() or len(set(y)) < 2:
        return [None] * len(test)
    x, test = x[:, free], test[:, free]
    w = newton(x, y, c)
    return (1 / (1 + np.exp(-np.clip((test - x.mean(0)) / x.std(0) @ w[:-1] + w[-1], -35, 35)))).tolist()


def oracle(rows, comparisons, label, stratum, key, seeds, folds, given=None, only=None):
    """(scores by (comparison, seed, key), strengths by (comparison, seed, fold)), one fit after the other."""
    found, strengths = {}, {}
    for seed in seeds:
        of = {r[key]: r[given] for r in rows} if given else folds_of(rows, label, stratum, key, folds, seed)
        for k in only or range(folds):
            train, test = [r for r in rows if of[r[key]] != k], [r for r in rows if of[r[key]] == k]
            inner = inner_of(train, label, key, seed)
            for name, d in comparisons.items():
                x, t = inputs(train, test, d)
                y, best = np.array([float(r[label]) for r in train]), (-1.0, 0.0, 1.0)
                for c in (0.1, 1.0, 10.0):
                    got = [None] * len(train)
                    for i in {v for v in inner.values() if v is not None}:
                        out = np.array([inner[r[key]] == i for r in train])
                        for j, s in zip(np.flatnonzero(out), fitted(x[~out], y[~out], x[out], c), strict=True):
                            got[j] = s
                    known = [j for j, s in enumerate(got) if s is not None]
                    a = brute_auroc([got[j] for j in known], y[known]) if known else None
                    best = max(best, (round(a, 12) if a is not None else -1.0, -c if a is not None else -math.inf, c))
                strengths[name, seed, k] = best[2]
                found |= {(name, seed, r[key]): s for r, s in zip(test, fitted(x, y, t, best[2]), strict=True)}
    return found, strengths


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        a, b = rng.gauss(0, 1), rng.gauss(50, 30)
        rows.append((i, a, b, 3 * a - b + rng.gauss(0, 5), 7.0, float(rng.random() < 0.02), int(rng.random() < 1 / (1 + math.exp(-(a - 0.02 * b)))), rng.choice("xyz")))
    df = spark.createDataFrame(rows, "id long, a double, b double, e double, k double, rare double, y int, src string").repartition(4)
    return df, [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("stratum", ["src", None])
def test_folds_and_inner_folds_of_many_seeds(small, stratum):
    df, rows = small
    groups = {r["id"]: set(r["groups"]) for r in learners.dealt(df, "y", stratum, "id", ("1", "2", "z"), 4).collect()}
    for r in rows:
        expected = set()
        for seed in ("1", "2", "z"):
            of = folds_of(rows, "y", stratum, "id", 4, seed)
            expected.add(f"s{seed}f{of[r['id']]}")
            for k in range(4):
                if of[r["id"]] != k:
                    expected.add(f"s{seed}k{k}i{inner_of([x for x in rows if of[x['id']] != k], 'y', 'id', seed)[r['id']]}")
        assert groups[r["id"]] == expected
    for seed in ("1", "2", "z"):  # of each fold's training rows every inner fold has each class in equal parts
        for k in range(4):
            sizes = Counter((next((g for g in groups[r["id"]] if g.startswith(f"s{seed}k{k}i")), None), r["y"]) for r in rows)
            for y in (0, 1):
                parts = [n for (g, label), n in sizes.items() if g and label == y]
                assert len(parts) == 3 and max(parts) - min(parts) <= 1


def test_comparisons_equal_serial_fits(small):
    df, rows = small
    comparisons = {"A": Design(["a"]), "AB": Design(["a", "b", "k"]), "R": Design(["a"], ["e"], ["a", "b"]), "none": Design(["k"]), "rare": Design(["rare", "b"])}
    scored, models = learners.compared(df, comparisons, "id", "y", "src", ("1", "2"), 4)
    expected, strengths = oracle(rows, comparisons, "y", "src", "id", ("1", "2"), 4)
    assert {tuple(m.name.split("|")[:2]) + (int(m.name.split("|")[2]),): m.c for m in models if "none" not in m.name} == {k: c for k, c in strengths.items() if k[0] != "none"}
    got = {(r["comparison"], r["seed"], r["id"]): r["score"] for r in scored.collect()}
    assert got.keys() == expected.keys()
    for k, s in expected.items():
        assert got[k] is None if s is None else got[k] == pytest.approx(s, abs=1e-7)
    assert len({m.c for m in models}) > 1
    details = {tuple(r[:3]): r for r in learners.fold_details(models, comparisons)}
    assert details["AB", "1", 0][6] == 1 and set(details["AB", "1", 0][7]) == {"a", "b"} and details["none", "1", 0][3] is None
    assert details["A", "1", 0][4] + sum(1 for v in folds_of(rows, "y", "src", "id", 4, "1").values() if v == 0) == len(rows)


def test_classes_too_small_for_inner_folds(small):
    df, rows = small
    some = df.withColumn("y", (F.col("id") < 3).cast("int"))
    scored, models = learners.compared(some, {"A": Design(["a"])}, "id", "y", None, ("1",), 3)
    expected, strengths = oracle([r | {"y": int(r["id"] < 3)} for r in rows], {"A": Design(["a"])}, "y", None, "id", ("1",), 3)
    assert [m.c for m in models] == [strengths["A", "1", k] for k in range(3)]
    assert {r["id"]: pytest.approx(r["score"], abs=1e-7) for r in scored.collect()} == {k[2]: s for k, s in expected.items()}
    _, one = learners.compared(df.withColumn("y", (F.col("id") == 0).cast("int")), {"A": Design(["a"])}, "id", "y", None, ("1",), 3)
    assert sorted(m.weights is None for m in one) == [False, False, True] and {m.c for m in one} == {1.0}


def test_rank_where_squares_lose_it(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    x[:, 3] = x[:, 0] + 1e-10 * x[:, 3]
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double").repartition(5)
    for columns in (["a", "b", "c", "d"], ["a", "b"], ["d", "a"]):
        at = ["abcd".index(c) for c in columns]
        rank, condition = learners.rank_and_condition(df, columns, standardised=False)
        assert rank == np.linalg.matrix_rank(x[:, at]) == len(columns) and condition == pytest.approx(np.linalg.cond(x[:, at]), rel=1e-3)
    sets = {"all": list("abcd"), "pair": ["a", "b"], "near": ["d", "a"], "twice": ["a", "a2"]}
    doubled, values = df.withColumn("a2", 2 * F.col("a")), np.column_stack([x, 2 * x[:, 0]])
    assert learners.ranks(doubled, sets) == {k: int(np.linalg.matrix_rank(values[:, [["a", "b", "c", "d", "a2"].index(c) for c in v]])) for k, v in sets.items()}
    summed = df.select("a", "b", (F.col("a") + F.col("b")).alias("s"))
    assert learners.rank_and_condition(summed, ["a", "b", "s"])[0] == learners.rank_and_condition(summed, ["a", "b", "s"], standardised=False)[0] == 2


@pytest.fixture(scope="module")
def featured(spark):
    return [r.asDict() for r in Q.featured(spark, SF).collect()] if os.path.isdir(SF) else []


def close(a, b):
    return a is None and b is None or a == pytest.approx(b, abs=2e-6)


def by_comparison(found, rows, label="err"):
    """Scores averaged over seeds of each comparison, with labels."""
    y = {r["doc_id"]: r[label] for r in rows}
    out = defaultdict(lambda: defaultdict(list))
    for (name, _, k), s in found.items():
        out[name][k].append(s)
    return {name: ([np.mean(v) for v in by.values()], [y[k] for k in by]) for name, by in out.items()}


@needs_tables
def test_query_scores(spark, featured):
    small_ = {"small": Design(Q.SMALL)}
    found, strengths = oracle(featured, small_, "err", "lang", "doc_id", ("2026",), 5)
    for r in Q.nested_regularisation(spark, SF).collect():
        assert close(r["score"], found["small", "2026", r["doc_id"]]) and r["c"] == strengths["small", "2026", r["fold"]]
    of = folds_of(featured, "err", "lang", "doc_id", 5, "2026")
    got = {r["doc_id"]: r["score"] for r in Q.logistic_out_of_fold(spark, SF).collect()}
    for k in range(5):
        train, test = [r for r in featured if of[r["doc_id"]] != k], [r for r in featured if of[r["doc_id"]] == k]
        for r, s in zip(test, fitted(*inputs(train, train, small_["small"])[:1], np.array([float(r["err"]) for r in train]), matrix(test, Q.SMALL), 1.0), strict=True):
            assert close(got[r["doc_id"]], s)


@needs_tables
def test_query_of_families(spark, featured):
    names = ["L", "L+W", "L+W~S"]
    comparisons = learners.designs(Q.FAMILIES, names, "L+W")
    got = {r["comparison"]: r for r in Q.family_comparisons(spark, SF).collect()}
    assert len(got) == 11
    found, _ = oracle(featured, comparisons, "err", "lang", "doc_id", Q.SEEDS, 5)
    for name in names:
        each = [brute_auroc(*by_comparison({k: s for k, s in found.items() if k[1] == seed}, featured)[name]) for seed in Q.SEEDS]
        assert close(got[name]["auroc"], each[0]) and close(got[name]["auroc_low"], min(each)) and close(got[name]["auroc_high"], max(each))
        columns = [c.lstrip("~") for c in comparisons[name].all]
        assert got[name]["features"] == len(columns) and got[name]["matrix_rank"] == np.linalg.matrix_rank(matrix(featured, columns))


@needs_tables
def test_queries_of_ablation_and_stability(spark, featured):
    names = ["L+W", "L+W+S"]
    found, _ = oracle(featured, learners.designs(Q.FAMILIES, names, "L+W"), "err", "lang", "doc_id", Q.SEEDS[:5], 5)
    mean = by_comparison(found, featured)
    got = {r["comparison"]: r["auroc"] for r in Q.feature_ablation(spark, SF).collect()}
    assert all(close(got[n], brute_auroc(*mean[n])) for n in names)
    one = by_comparison({k: s for k, s in found.items() if k[1] == "2026"}, featured)
    got = {r["comparison"]: r for r in Q.depth_ablation(spark, SF).collect()}
    base = brute_auroc(*one["L+W"])
    assert all(close(got[n]["auroc"], brute_auroc(*one[n])) and close(got[n]["gain"], brute_auroc(*one[n]) - base) for n in names)


@needs_tables
def test_queries_of_protocols_and_transfer(spark, featured):
    languages = sorted({r["lang"] for r in featured})
    rows = [r | {"group": languages.index(r["lang"]), "target": int(r["lang"] != "en")} for r in featured]
    y = {r["doc_id"]: (r["err"], r["lang"]) for r in rows}
    got = {(r["protocol"], r["lang"]): r["auroc"] for r in Q.group_protocols(spark, SF).collect()}
    left, _ = oracle(rows, {"all": Design(Q.SMALL)}, "err", None, "doc_id", ("all",), len(languages), "group")
    out = {(r["comparison"], r["lang"]): r["auroc"] for r in Q.transfer(spark, SF).collect()}
    moved, _ = oracle(rows, learners.designs(Q.FAMILIES, ["L", "L+W~R"], "L+W"), "err", None, "doc_id", ("all",), 2, "target", (1,))
    for g in languages:
        part = [(s, y[k[2]][0]) for k, s in left.items() if y[k[2]][1] == g and s is not None]
        assert close(got["left out", g], brute_auroc(*zip(*part, strict=True)))
        own, _ = oracle([r for r in rows if r["lang"] == g], {"all": Design(Q.SMALL)}, "err", None, "doc_id", ("2026",), 5)
        part = [(s, y[k[2]][0]) for k, s in own.items() if s is not None]
        assert close(got.get(("own", g)), brute_auroc(*zip(*part, strict=True)) if part else None)
        if g != "en":
            for name in ("L", "L+W~R"):
                part = [(s, y[k[2]][0]) for k, s in moved.items() if k[0] == name and y[k[2]][1] == g]
                assert close(out[name, g], brute_auroc(*zip(*part, strict=True)))


def test_aurocs_of_many_models_without_a_row_a_score(spark, monkeypatch):
    draw = random.Random(11)
    rows = [(i, draw.choice([0.0, 0.0, 0.0, draw.random()]), float(draw.randrange(4)), int(draw.random() < 0.4), [f"g{draw.randrange(3)}", f"h{draw.randrange(2)}"]) for i in range(500)]
    df = spark.createDataFrame([*rows, (500, None, 1.0, 1, ["g0"]), (501, 1.0, 1.0, None, ["g0"])], "id int, a double, b double, y int, groups array<string>").repartition(3)
    design, models = Design(["a", "b"]), []
    for name, test in (("both", "g0"), ("both", "g1"), ("other", "g2"), ("skipped", "h0"), ("none", "h9")):
        models.append(learners.Model(f"{name}|{test}", [], [test], ["g1"] if name == "skipped" else []))
        models[-1].link = np.array([draw.gauss(0, 1) for _ in range(3)])
    models.append(learners.Model("unfitted|g0", [], ["g0"]))
    same = lambda m: m.name.split("|")[0]
    scored = learners.scores(df.filter("y is not null"), design, "id", "y", models).filter("score is not null").collect()
    expected = {}
    for name in ("both", "other", "skipped"):
        own = [r for r in scored if r["name"].split("|")[0] == name]
        expected[name] = pytest.approx(brute_auroc([r["score"] for r in own], [r["y"] for r in own]), abs=1e-12)
    for ranges, block in ((1 << 16, 8192), (20, 7)):
        monkeypatch.setattr(learners, "RANGE", ranges)
        monkeypatch.setattr(learners, "RANKED", block)
        assert learners.aurocs(df, design, "y", models, same) == expected
    monkeypatch.setattr(learners.metrics, "auroc", None)  # strengths are chosen without it
    learners.fitted(df.drop("groups").filter("a is not null").withColumn("y", F.coalesce("y", F.lit(0))), {"A": design}, "id", "y", None, ("1",), 3)
