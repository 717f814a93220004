"""Operators on small rows against independent computations and stated examples."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.functions import arrays as A
from gradeflow.functions import features as X
from gradeflow.functions import grading as G
from gradeflow.operators import aliases, gates, integrity, learners, overlaps, sampling, tails
from gradeflow.sources import loaders, records


def newton(x, y, c):
    """Balanced L2 logistic regression on standardised columns, by numpy alone."""
    n, d = x.shape
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(n)])
    cw = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    w, penalty = np.zeros(d + 1), np.append(np.full(d, 1 / c), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (cw * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (cw * (p - y)) + penalty * w)
    return w


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        a, b = rng.gauss(0, 1), rng.gauss(2, 3)
        y = int(rng.random() < 1 / (1 + math.exp(-(1.2 * a - 0.3 * b))))
        rows.append((i, a, b, 2 * a - b + rng.gauss(0, 0.5), 7.0, y, i % 4, i % 3, "s" if i % 2 else "t"))
    return spark.createDataFrame(rows, "id long, a double, b double, e double, k double, y int, fold int, inner int, src string").repartition(3)


def test_logistic_equals_another_fit(table):
    pd = table.toPandas().sort_values("id")
    for c in (0.1, 1.0, 10.0):
        models = learners.fit_many(table.withColumn("groups", learners.by_fold()), learners.Design(["a", "b", "k"]), "y", learners.fold_models([0, 1, 2, 3], c))
        for m, k in zip(models, range(4)):
            train = pd[pd.fold != k]
            expected = newton(train[["a", "b"]].to_numpy(), train["y"].to_numpy(float), c)
            assert np.allclose(m.weights[[0, 1, 3]], expected, atol=1e-7) and m.weights[2] == 0 and m.scale[2] == 0
    scored = learners.out_of_fold(table, "id", "y", ["a", "b"])
    assert scored.count() == 240 and scored.filter("score is null").count() == 0
    train = pd[pd.fold != 2]
    x, w = train[["a", "b"]].to_numpy(), newton(train[["a", "b"]].to_numpy(), train["y"].to_numpy(float), 1.0)
    for r in scored.filter("fold = 2").collect():
        row = pd[pd.id == r["id"]][["a", "b"]].to_numpy()[0]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(((row - x.mean(0)) / x.std(0)) @ w[:-1] + w[-1]))), abs=1e-7)


def test_one_class_gives_no_scores(table):
    rows = table.withColumn("y", F.when(F.col("fold") == 1, F.col("y")).otherwise(0))
    by = {r["fold"]: r["n"] for r in learners.out_of_fold(rows, "id", "y", ["a"]).groupBy("fold").agg(F.count("score").alias("n")).collect()}
    assert by[1] == 0 and by[0] > 0


def test_residual_features_are_ridges_of_the_training_rows(table):
    pd = table.toPandas()
    design = learners.Design([], ["e"], ["a", "b"])
    (m,) = learners.fit_many(table.withColumn("groups", learners.by_fold()), design, "y", learners.fold_models([1]))
    train = pd[pd.fold != 1]
    x, y = train[["a", "b"]].to_numpy(), train["e"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(m.on_controls[0], w) and m.base[0] == pytest.approx(y.mean() - w @ x.mean(0))
    assert m.mean[0] == pytest.approx((y - m.base[0] - x @ w).mean(), abs=1e-9)


def test_transfer_and_stability(table):
    out = learners.transferred(table, {"A": learners.Design(["a", "b"])}, "id", "y", "src", "s")
    assert {r["src"] for r in out.select("src").distinct().collect()} == {"t"} and out.count() == 120
    _, models = learners.compared(table, {"A": learners.Design(["a", "b"])}, "id", "y", "src")
    rows = learners.stability(models, ["a", "b"])
    assert [r[0] for r in rows] == ["a", "b", "norm"] and rows[0][1] > 0 and rows[0][3] == 1.0 and rows[1][3] == 0.0
    rank, condition = learners.rank_and_condition(table.withColumn("f", F.col("a") + F.col("b")), ["a", "b", "f", "k"])
    assert rank == 2 and condition < 10


def test_ranks_by_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 1.0, 2.0, rng.random() * 100]), rng.choice("xyz"), rng.randrange(3)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, v double, g string, e int").repartition(4)
    for by in ([], ["g"]):
        got = {r["id"]: (r["rank"], r["n"], r["so_far"]) for r in sampling.ranked(df, "v", "id", by, total="e", ranges=7).collect()}
        groups = {}
        for r in rows:
            groups.setdefault(r[2] if by else 0, []).append(r)
        for part in groups.values():
            total = 0
            for i, r in enumerate(sorted(part, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))):
                total += r[3]
                assert got[r[0]] == (i + 1, len(part), total)
    for n in (1, 3, 4, 5, 10, 11):
        tiles = [r["t"] for r in spark.range(1, n + 1).select(sampling.tile(F.col("id"), F.lit(n), 4).alias("t")).collect()]
        assert tiles == sorted(tiles) and max(tiles.count(t) for t in set(tiles)) - min(tiles.count(t) for t in set(tiles)) <= 1
    assert sampling.ranked(df.filter("false"), "v", "id").count() == 0


def test_quotas_sum_to_the_size(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate("a" * 70 + "b" * 20 + "c" * 9 + "d")], "id long, s string")
    for size in (4, 7, 10, 33, 50, 99, 100, 500):
        got = {r["s"]: r["quota"] for r in sampling.quotas(df, "s", size).collect()}
        assert sum(got.values()) == min(size, 100) and min(got.values()) >= 1 and got["d"] == 1, size
        assert sampling.proportional(df, "s", "id", size, "x").count() == min(size, 100)


def test_samples(spark):
    df = spark.createDataFrame([(i, f"c{i // 3}", i % 2, float(i * 7 % 50), float(i % 11)) for i in range(400)], "id long, ctx string, y int, u double, v double")
    got = sampling.unique_balanced(df, "ctx", "y", "id", 30, "s")
    assert got.select("ctx").distinct().count() == got.count() == 60
    cells = sampling.crossed(df, "u", "v", "id", 100, "s")
    assert cells.count() == 100 and cells.select("stratum").distinct().count() >= 8
    with pytest.raises(ValueError, match="400 rows, not 401"):
        sampling.limited(df, "u", "id", 401)
    counts = [sampling.folds(df, "y", "ctx", "id", 5, seed).select("id", "fold").collect() for seed in ("1", "2")]
    assert counts[0] != counts[1]


def test_statistics_against_known_values(spark):
    rows = spark.createDataFrame([(0.0098, -0.0006, 0.0202, 795, 2000), (0.02, 0.01, 0.03, 795, 2000), (0.0, 0.0, 0.0, 10, 20), (0.1, 0.1, 0.1, 10, 20), (None, -0.1, 0.1, 10, 20)], "gain double, low double, high double, n long, target long")
    of = [F.col(c) for c in rows.columns]
    got = rows.select(gates.power(*of).alias("p"), gates.power_gate(*of).alias("g")).collect()
    assert got[0]["p"] == pytest.approx(0.8354, abs=2e-3) and [r["g"] for r in got[:2]] == [True, False]
    assert got[2]["p"] == 0.0 and got[3]["p"] == 1.0 and got[4]["p"] is None
    z = statistics.NormalDist()
    values = [-30.0, -8.3, -1.96, 0.0, 0.5, 3.0, 39.0]
    below = spark.createDataFrame([(v,) for v in values], "z double").select("z", tails.normal_below(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(z.cdf(r["z"]), abs=1e-15) for r in below) and below[0]["p"] > 0
    assert [list(r) for r in A.depth_regions(8)] == [[0, 1, 2], [3, 4, 5], [6, 7]] and sum(map(len, A.depth_regions(23))) == 23
    with pytest.raises(ValueError):
        A.depth_regions(2)


def test_tails_of_students_t(spark):
    cases = [(0.5, 20, 0.0247696), (-0.5, 20, 0.0247696), (0.0, 10, 1.0), (1.0, 10, 0.0), (-1.0, 5, 0.0), (None, 10, None), (0.3, 2, None), (0.9, 3, 1 - 2 / math.pi * math.atan(0.9 / math.sqrt(0.19)))]
    rows = spark.createDataFrame([c[:2] for c in cases], "rho double, n long").coalesce(1)
    got = [r["p"] for r in rows.select(tails.correlation_p(F.col("rho"), F.col("n")).alias("p")).collect()]
    assert all(g is None if c[2] is None else g == pytest.approx(c[2], abs=1e-6) for g, c in zip(got, cases, strict=True))
    t, v = np.meshgrid([0.01, 0.7, 2.0, 9.0, 60.0], [1, 2, 3, 10, 1000, 100_000])
    x = np.linspace(0, 1, 40_001)
    for a, n in zip(t.ravel().tolist(), v.ravel().tolist(), strict=True):
        density = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + (a * x) ** 2 / n) ** (-(n + 1) / 2)
        inside = a * np.trapezoid(density, x)
        assert float(tails.beta_ratio(n / (n + a * a), n / 2, 0.5)) == pytest.approx(1 - 2 * inside, abs=2e-7)


def test_labels_of_interpretations(spark):
    two = [("a", ["Paris"]), ("b", ["London", "the city of London"])]
    shared = [("a", ["Paris"]), ("b", ["paris", "London"])]
    rows = [
        (1, "Rome", two, "incorrect", 0.0),
        (2, "Paris", two, "partially_correct", 1.0),
        (3, "Paris; London", two, "fully_correct", 1.0),
        (4, "1. London\n2. Paris", two, "incorrect", 0.0),
        (5, "1. Paris\n2. London", two, "partially_correct", 0.5),
        (6, "Paris", shared, None, 1.0),
        (7, "", two, "incorrect", 0.0),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id long, response string, interpretations array<struct<name: string, aliases: array<string>>>")
    got = {r["id"]: (r["label"], r["precision"]) for r in G.interpretation_labels(df).collect()}
    assert got == {i: (label, p) for i, _, _, label, p in rows}


def test_grading_rules(spark):
    schema = "id long, dataset string, response string, aliases array<string>, wrong_aliases array<string>, answerable boolean, interpretations array<struct<name: string, aliases: array<string>>>"
    rows = [
        (1, "triviaqa", "The Paris!", ["paris"], [], True, None),
        (2, "squad", "Unanswerable", ["x"], [], False, None),
        (3, "squad", "It is not stated", ["x"], [], False, None),
        (4, "ambignq", "Paris", ["paris"], [], True, []),
        (5, "truthfulqa", "paris", ["paris"], ["rome"], True, None),
        (6, "gsm8k", "1 then 2 then #### 3", ["3"], [], True, None),
        (7, "arithmetic", "2 plus 2 is 4", ["4"], [], True, None),
    ]
    got = {r["id"]: (r["correct"], r["error"], r["unresolved"]) for r in G.graded(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (True, 0, False), 2: (True, 0, False), 3: (True, 0, False), 4: (True, 0, False), 5: (None, None, True), 6: (True, 0, False), 7: (False, 1, False)}
    empty = spark.createDataFrame([(1, "x", [])], "id long, response string, aliases array<string>")
    with pytest.raises(Exception, match="no aliases"):
        G.prepared(empty, "response", a="aliases").select(G.best_f1("a")).collect()
    with pytest.raises(Exception, match="unknown dataset"):
        G.graded(spark.createDataFrame([(1, "other", "x", ["y"], [], True, None)], schema)).collect()
    tail = G.prepared(spark.createDataFrame([(1, "it is Paris", ["Paris"]), (2, "Paris it is not", ["Paris"])], "id long, response string, aliases array<string>"), "response", a="aliases")
    assert {r["id"]: r["c"] for r in tail.select("id", G.concise("a").alias("c")).collect()} == {1: "concise_containment", 2: None}


def test_loaders(spark):
    texts = spark.createDataFrame([("so #### 1,234",), ("#### 8.0",), ("#### 0.25",), ("#### NaN",), ("#### twelve",), ("8",), (None,), ("#### +9",)], "t string")
    assert [r["n"] for r in texts.select(loaders.gold_number(F.col("t")).alias("n")).collect()] == ["1234", "8", "0.25", None, None, None, None, "9"]
    sums = spark.createDataFrame([("7 * 6",), ("7 / 2",), ("8 / 2",), ("8 / 0",), ("-3 - 4",), ("2 ^ 3",), ("x",)], "e string")
    assert [r["v"] for r in sums.select(loaders.arithmetic(F.col("e"))["value"].alias("v")).collect()] == [42, None, 4, None, -7, None, None]
    spans = spark.createDataFrame([(1, "q", "abcdef", 2, "cd"), (2, "q", "abcdef", 3, "cd"), (3, "q", "abcdef", None, None), (4, "q", " ", 0, "a")], "id long, q string, c string, s int, a string")
    assert {r["example_id"]: r["fault"] for r in loaders.with_spans(spans, "id", "q", "c", "s", "a").collect()} == {"squad:1": None, "squad:2": "span_not_in_context", "squad:3": None, "squad:4": "no_context"}
    written = {}
    raw = loaders.with_aliases(spark.createDataFrame([(1, "q", [" a ", "", "a"]), (2, " ", ["a"]), (3, "q", [" "])], "id long, q string, al array<string>"), "nq", "id", "q", F.col("al"))
    assert loaders.prepare_all({"nq": raw}).first().asDict() == {"dataset": "nq", "rows": 3, "good": 1, "faults": 2} and not written
    loaders.prepare_all({"nq": raw}, lambda name, rows: written.update({name: rows.count()}))
    assert written == {"nq": 1} and {r["fault"] for r in loaders.quarantined(raw).collect()} == {"blank_question", "no_answers"}


def test_gates(spark):
    good = spark.createDataFrame([(i, "m", i % 2) for i in range(100)], "id long, m string, ok int")
    never, ok = F.lit(False), F.col("ok") == 1
    gate = lambda df, **k: gates.model_gate(df, ["m"], k.get("t", never), k.get("s", F.lit("ok")), ok, k.get("v", F.lit(True)), F.lit(k.get("n", 1000))).first()["reasons"]
    assert gate(good) == "passed" and gate(good.filter("id < 99")) == "record_count_mismatch" and gate(good, n=150) == "projected_minority_below_100"
    assert gate(good.withColumn("ok", F.lit(1)), t=F.col("id") < 6, s=F.when(F.col("id") < 6, "error"), v=never) == "truncation_above_5_percent,parsing_failure_above_5_percent,artifact_verification_failure,one_class_calibration"
    assert gates.label_gate(good, ["m"], "ok", 100).first()["passed"] and not gates.label_gate(good, [], "ok", 99).first()["passed"]
    empty = gates.label_gate(good.filter("false"), [], "ok", 0).first()
    assert empty["unresolved_rate"] == 1.0 and not empty["passed"]
    with pytest.raises(PermissionError):
        gates.require(spark.createDataFrame([("v4", False)], "version string, passed boolean"), "v4")
    assert gates.first_gate(good, "id", never, F.lit("ok")).first()["passed"] and not gates.first_gate(good, "id", never, F.when(F.col("id") != 5, "ok")).first()["passed"]
    done = gates.verification(good, good, "id", F.lit(True), [])
    assert done.first()["passed"] and done.first()["valid"] == 100


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 2.0, None), (2, 5.0, 6.0, 5.0, 1.0)], "id long, a double, b double, c double, d double")
    assert X.equal_columns(df, "id", ["a", "b", "c", "d"]) == [["a", "c"]]
    with pytest.raises(KeyError):
        X.compact(df, "id", ("z",))
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([([1.0, float("nan")],)], "x array<double>").select(A.finite(F.col("x"))).collect()
    bad = spark.createDataFrame([([[[1.0], [2.0]]],)], "t array<array<array<double>>>")
    with pytest.raises(Exception, match="no answer tokens"):
        bad.select(A.aligned(F.col("t"), F.lit(1), 2)).collect()
    assert integrity.forbidden(spark.createDataFrame([((1, "x"),)], "m struct<a: int, Response: string>"), gates.BANNED) == ["Response"]
    assert records.markdown(df.select("id", "d")) == "| id | d |\n|-|-|\n| 1 | — |\n| 2 | 1 |"


def test_overlaps_of_three_kinds(spark):
    kind = "example_id string, split string, source_id string, question string"
    rows = [("a:1", "validation", "10", "Who wrote it?"), ("n:1", "train", "10", "Another"), ("n:2", "test", "99", "who wrote it"), ("n:3", "train", "98", "Alone"), ("n:4", "train", "", ""), ("n:5", "train", None, None), ("n:6", "train", "99", "Third"), ("n:7", "test", "77", "third!"), ("n:8", "train", "66", "The third")]
    df = spark.createDataFrame(rows, kind).repartition(3)
    got = sorted(map(tuple, overlaps.overlaps(df).collect()))
    assert got == sorted([(overlaps.SOURCE, "n:1", "a:1"), (overlaps.QUESTION, "n:2", "a:1"), (overlaps.SPLIT, "n:1", "a:1"), (overlaps.SPLIT, "n:2", "a:1"), (overlaps.SOURCE, "n:6", "n:2"), (overlaps.SPLIT, "n:6", "n:2"), (overlaps.QUESTION, "n:7", "n:6"), (overlaps.QUESTION, "n:8", "n:6"), (overlaps.SPLIT, "n:7", "n:6"), (overlaps.SPLIT, "n:8", "n:7")])
    members = {r["example_id"]: (r["group"], r["size"], r["splits"]) for r in overlaps.groups(df).collect()}
    assert {members[x] for x in ("a:1", "n:1", "n:2", "n:6", "n:7", "n:8")} == {("a:1", 6, 3)} and members["n:3"] == ("n:3", 1, 1) and members["n:4"] == ("n:4", 1, 1)
    with pytest.raises(ValueError, match="Duplicate example ID: a:1"):
        overlaps.overlaps(df.unionByName(df.filter("example_id = 'a:1'")))
    assert overlaps.overlaps(df.filter("false")).count() == overlaps.groups(df.filter("false")).count() == 0


def test_groups_of_long_chains(spark):
    rng = random.Random(5)
    ids = list(range(300))
    rng.shuffle(ids)
    rows = [(f"{i:05d}", "train", str(place // 2), f"question {(place + 1) // 2}") for place, i in enumerate(ids)]
    members = overlaps.groups(spark.createDataFrame(rows, "example_id string, split string, source_id string, question string")).collect()
    assert {(r["group"], r["size"]) for r in members} == {("00000", 300)}


def test_loaders_of_annotated_questions(spark):
    note = lambda *x: loaders_row(*x)

    def loaders_row(kind, answer=None, pairs=None):
        return (kind, answer, pairs)

    rows = [("10", "Who wrote it?", [note("singleAnswer", ["A. Writer", ""])]), ("11", "When did it begin?", [note("multipleQAs", None, [("When did event A begin?", ["1900"]), ("When did event B begin?", ["2000"])])]), ("12", None, [note("singleAnswer", ["x"])]), ("13", "Q", None), ("14", "Q", [note("odd")]), ("15", "Q", [note("multipleQAs", None, [("a", [" "])])]), (None, "Q", [note("singleAnswer", ["x"])])]
    got = {r["source_id"]: r for r in loaders.ambiguous(spark.createDataFrame(rows, loaders.AMBIGUOUS), "validation").collect()}
    one, two = got["10"], got["11"]
    assert one["example_id"] == "ambignq:validation:10" and one["aliases"] == ["A. Writer"] and one["is_ambiguous"] is False and one["n_interpretations"] == 1 and one["interpretations"] == []
    assert two["is_ambiguous"] is True and two["n_interpretations"] == 2 and [x["aliases"] for x in two["interpretations"]] == [["1900"], ["2000"]] and two["fault"] is None
    assert {k: got[k]["fault"] for k in ("12", "13", "14", "15", None)} == {"12": "blank_question", "13": "no_answers", "14": "unknown_annotation", "15": "interpretation_without_answers", None: "no_id"}


def test_loaders_of_truthfulness_and_evidence(spark, tmp_path):
    lines = [",".join(loaders.TRUTHFUL), 'Adversarial,Test,Is this true?,Yes,No,"Yes; Correct","No; Incorrect",fixture', 'Adversarial,Test,"Is ""it"", then?",Maybe,,"Yes; Correct",,fixture', "too,short"]
    (tmp_path / "truth.csv").write_text("\n".join(lines) + "\n")
    got = loaders.truthful(loaders.read_truthful(spark, str(tmp_path / "truth.csv"))).collect()
    first = next(r for r in got if r["question"] == "Is this true?")
    assert first["aliases"] == ["Yes", "Correct"] and first["wrong_aliases"] == ["No", "Incorrect"] and first["fault"] is None and first["example_id"].startswith("truthfulqa:validation:")
    assert sorted(str(r["fault"]) for r in got) == ["None", "malformed_line", "no_wrong_answers"]
    assert next(r for r in got if r["fault"] == "no_wrong_answers")["question"] == 'Is "it", then?'
    kind = loaders.EVIDENCE
    rows = [("q1", "Who wrote the book?", ("Ada", ["Ada", "A. Author"], ["ada", "a author"]), [("Book.txt", "Book", "TagMe")], [("web/1.txt", "Hit", "http://x")]), ("q2", "Who?", None, None, None)]
    wiki = {r["source_id"]: r for r in loaders.with_evidence(spark.createDataFrame(rows, kind), "validation").collect()}
    assert wiki["q1"]["aliases"] == ["Ada", "A. Author"] and wiki["q1"]["normalised_aliases"] == ["ada", "a author"] and wiki["q1"]["evidence"][0]["path"] == "evidence/wikipedia/Book.txt" and wiki["q2"]["fault"] == "answerless"
    web = loaders.with_evidence(spark.createDataFrame(rows, kind), "validation", "web").first()
    assert web["evidence"][0]["path"] == "evidence/web/web/1.txt"


def test_answers_against_very_many_aliases(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    answers = [(rng.randrange(3), i, " ".join(word() for _ in range(rng.randrange(0, 7)))) for i in range(120)]
    given = [(rng.randrange(3), " ".join(word() for _ in range(rng.randrange(1, 4)))) for _ in range(400)] + [(0, ""), (1, "The")]
    one, two = aliases.prepared(spark.createDataFrame(answers, "q int, id int, r string"), spark.createDataFrame(given, "q int, a string"), "q", "id", "r", "a")
    norm = lambda t: " ".join(w for w in t.lower().split() if w not in ("a", "an", "the"))
    by = {q: {norm(a) for k, a in given if k == q} for q in range(3)}
    inside, best, same = {(r["id"], r["a"]) for r in aliases.contained(one, two).collect()}, {r["id"]: r["best_f1"] for r in aliases.best_overlap(one, two).collect()}, {r["id"] for r in aliases.exact_matches(one, two).collect()}

    def f1(x, y):
        x, y = x.split(), y.split()
        common = sum(min(x.count(w), y.count(w)) for w in set(x))
        return 1.0 if not x and not y else 2 * common / (len(x) + len(y)) if x and y else 0.0

    assert inside == {(i, a) for q, i, r in answers for a in by[q] if a and a in norm(r)}
    assert all(best[i] == pytest.approx(max(f1(norm(r), a) for a in by[q])) for q, i, r in answers) and len(best) == 120
    assert same == {i for q, i, r in answers if norm(r) in by[q]}


def test_a_stream_that_is_stopped_and_started_again(spark, tmp_path):
    from gradeflow.streaming import collect, monitor

    for name, ids in (("a", range(0, 40)), ("b", range(40, 60))):
        spark.createDataFrame([(i, "first") for i in ids], "id long, t string").repartition(2).write.json(str(tmp_path / "in" / name))
    calls = []

    def stop(batch, number):
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("stopped")

    start = lambda after=None: collect.collect(collect.arriving(spark, str(tmp_path / "in/*"), "id long, t string", 1), str(tmp_path / "out"), str(tmp_path / "checkpoint"), after)
    with pytest.raises(Exception, match="stopped"):
        start(stop).awaitTermination()
    assert len(calls) == 2
    spark.createDataFrame([(7, "again")], "id long, t string").write.json(str(tmp_path / "in" / "c"))
    start().awaitTermination()
    start().awaitTermination()
    got = {r["id"]: r["t"] for r in collect.collected(spark, str(tmp_path / "out"), "id long, t string", "id").collect()}
    assert got == {i: "again" if i == 7 else "first" for i in range(60)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 61  # nothing was written twice
    assert collect.collected(spark, str(tmp_path / "none"), "id long, t string", "id").count() == 0
    events = spark.createDataFrame([(i, float(i)) for i in range(3)], "id long, value double").withColumn("ts", F.timestamp_seconds(F.col("id") * 3600))
    assert [tuple(r)[1:] for r in monitor.rate(events, "ts", F.col("value") > 0).orderBy("start").collect()] == [(1, 0, 0.0), (1, 1, 1.0), (1, 1, 1.0)]
    assert monitor.first_of_each(events.unionByName(events), "id", "ts").count() == 3
