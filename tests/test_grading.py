"""Grading of odd responses: stated examples, and rows that may not vanish or end a query."""

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import features as X
from gradeflow.functions import grading as G
from gradeflow.functions import text as T


def answers(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [tuple(r["a"]) for r in rows.select("i", f(F.col("t")).alias("a")).orderBy("i").collect()]


def test_numbers_of_odd_texts(spark):
    texts = ["é5", "_5", "x 5", "-0", "+0.00", "007", "3/4", "3 / 4 is", "1,234", "1.50", "no", " ", None, "5 and 6", "answer: 7", "5 then final answer is 12."]
    only, bad = (None, None, "error"), "error"
    expected = [(*only, T.NO_NUMBER), (*only, T.NO_NUMBER), ("5", "5", "ok", None), ("-0", "0", "ok", None), ("+0.00", "0", "ok", None), ("007", "7", "ok", None), (*only, T.IS_FRACTION), (*only, T.IS_FRACTION), ("1,234", "1234", "ok", None), ("1.50", None, bad, T.NOT_INTEGER)]
    expected += [(*only, T.NO_NUMBER), (*only, T.EMPTY), (*only, T.EMPTY), (*only, T.SEVERAL), ("7", "7", "ok", None), ("12", "12", "ok", None)]
    assert answers(spark, texts, T.integer_answer) == expected


def test_final_numbers_of_odd_texts(spark):
    texts = ["3/4", "so 1/2 or 9", r"\boxed{ 5 } and 6", "5 and 6", "#### -0", "none", "answer 2.5"]
    expected = [(None, None, "error", T.IS_FRACTION), ("9", "9", "ok", None), ("5", "5", "ok", None), ("6", "6", "ok", None), ("-0", "0", "ok", None), (None, None, "error", T.NO_NUMBER), ("2.5", None, "error", T.NOT_INTEGER)]
    assert answers(spark, texts, T.final_number) == expected


def test_numbered_lines_of_any_length(spark):
    rows = spark.createDataFrame([("20240101123456. date\n99999999999999999999. far\n2) two\r\n 3. three",)], "t string")
    got = rows.select(T.numbered(F.col("t")).alias("n")).first()["n"]
    assert [(x["place"], x["text"]) for x in got] == [(20240101123455, "date"), (None, "far"), (1, "two"), (2, "three")]


@pytest.fixture(scope="module")
def responses(spark):
    kind = "id int, dataset string, response string, aliases array<string>, wrong_aliases array<string>, answerable boolean, interpretations array<struct<name:string,aliases:array<string>>>"
    a, b = ("a", ["Paris"]), ("b", ["Rome", "Paris"])
    rows = [(1, "x", "Paris", ["Paris"], ["Rome"], True, [a, b]), (2, "x", "1. Paris\n2. Rome", ["p"], [], True, [a, b]), (3, "x", "Paris", ["p"], [], True, []), (4, "x", "Paris", ["p"], [], True, None), (5, "x", None, ["p"], [], True, [a]), (6, "x", "20240101123456. Rome", ["p"], [], True, [b])]
    return spark.createDataFrame(rows, kind)


def test_no_response_vanishes(responses):
    c = {r["id"]: r for r in G.coverage(responses).collect()}
    assert {i: (r["interpretations"], r["covered"], r["coverage"], r["best_f1"]) for i, r in c.items()} == {1: (2, 2, 1.0, 1.0), 2: (2, 2, 1.0, 1.0), 3: (0, 0, None, 0.0), 4: (0, 0, None, 0.0), 5: (1, 0, 0.0, 0.0), 6: (1, 0, 0.0, c[6]["best_f1"])}
    labels = {r["id"]: (r["label"], r["unresolved"], r["ordinal"]) for r in G.interpretation_labels(responses).collect()}
    assert labels[3] == labels[4] == labels[5] == ("incorrect", False, 0) and labels[1] == (None, True, None) and len(labels) == 6
    recalled = {r["id"]: (r["interpretations"], r["matched"], r["any_match"], r["recall"]) for r in G.recall(responses).collect()}
    assert recalled[3] == recalled[4] == (0, 0, False, None) and recalled[1] == (2, 2, True, 1.0) and len(recalled) == 6


def test_aliases_as_given_and_kinds(spark):
    rows = [(1, "paris", ["the Paris!", "Rome"]), (2, "the Paris!", ["the Paris!"]), (3, "It is Paris", ["The PARIS"]), (4, "Paris is the largest of all", ["Paris"]), (5, "york", ["New York"]), (6, "red big cat", ["red big dog"]), (7, "zzz", ["Paris"]), (8, "one two three four", ["one five six seven"])]
    x = G.prepared(spark.createDataFrame(rows, "id int, response string, aliases array<string>"), "response", a="aliases")
    kinds = {r["id"]: r["k"] for r in x.select("id", G.alias_category("a", "aliases", F.array_contains("aliases", F.col("response"))).alias("k")).collect()}
    assert [kinds[i] for i in (2, 1, 3, 4, 5, 6, 7, 8)] == list(G.ALIAS_CATEGORIES)
    c = x.filter("id = 1").select(G.containment("a", "aliases").alias("c")).first()["c"]
    assert c["contained_aliases"] == c["containing_aliases"] == ["the Paris!"] and c["best_alias"] == "the Paris!" and c["best_f1"] == 1.0


def test_unchanged_records_keep_their_verdict(spark):
    kind = "id int, dataset string, response string, aliases array<string>, wrong_aliases array<string>, answerable boolean, interpretations array<struct<name:string,aliases:array<string>>>"
    rows = [(1, "gsm8k", "#### 7", ["7"], [], True, None), (2, "gsm8k", "#### 8", ["7"], [], True, None), (3, "squad", "it", ["it"], [], True, None), (4, "squad", "", ["it"], [], False, None), (5, "squad", "Insufficient context", ["it"], [], False, None), (6, "squad", "Rome", [""], [], False, None), (7, "truthfulqa", "a", ["b"], ["c"], True, None), (8, "ambignq", "it", ["it"], [], True, [])]
    got = {r["id"]: (r["status"], r["correct"]) for r in G.revised(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("unchanged", True), 2: ("unchanged", False), 3: ("unchanged", True), 4: ("canonical", True), 5: (T.ABSTENTIONS[2], True), 6: ("unsupported_answer", False), 7: ("neither", None), 8: ("one_interpretation", True)}


def test_a_null_label_that_is_there_is_no_error(spark):
    rows = spark.createDataFrame([(1, 1, True, True), (2, None, True, False), (3, None, False, False), (4, None, False, None), (5, 0, True, False)], "id int, e int, there boolean, ok boolean")
    assert [r["v"] for r in rows.select("id", X.first_verdict("e", "ok", present=F.col("there")).alias("v")).orderBy("id").collect()] == [False, True, False, False, True]


def test_abstentions_of_both_forms(spark):
    rows = spark.createDataFrame([(1, "un-known"), (2, "Unknown"), (3, "Unanswerable"), (4, "Paris")], "id int, t string")
    got = {r["id"]: (r["a"], r["b"]) for r in rows.select("id", T.malformed_abstention(F.col("t")).alias("a"), T.malformed_abstention(F.col("t"), flat=True).alias("b")).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (False, False), 4: (False, False)}


def test_manifests_of_options(spark):
    import hashlib
    import json

    from gradeflow.operators import sampling

    rows = [("b", ["Yes", "Surely"], ["No", 'say "no"'], "Yes"), ("a", ["x"], [], "other"), ("c", ["same", "same"], ["é"], "same")]
    df = spark.createDataFrame(rows, "id string, good array<string>, bad array<string>, best string")
    got = {r["id"]: r for r in sampling.choice_manifest(df, "id", "good", "bad", "best", F.lit("s")).collect()}
    for place, (key, good, bad, best) in enumerate(sorted(rows)):
        seed = int(hashlib.sha256(key.encode()).hexdigest()[:16], 16)
        options = sorted([(x, x in good) for x in good] + [(x, False) for x in bad], key=lambda o: (hashlib.sha256(f"{seed}:{o[0]}".encode()).hexdigest(), o[0]))
        r = got[key]
        assert r["selection_order"] == place and r["option_count"] == len(options) and r["correct_option_indices"] == [i for i, o in enumerate(options) if o[1]]
        assert r["correct_option_index"] == next((i for i, o in enumerate(options) if o == (best, True)), None)
        assert r["option_order_checksum"] == hashlib.sha256(json.dumps([o[0] for o in options], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_what_is_wrong_with_a_collection(spark):
    import hashlib

    from gradeflow.operators import gates

    prompt = lambda i: f"prompt {i}"
    rows = [(i, f"d{i % 2}", "one", prompt(i), hashlib.sha256(prompt(i).encode()).hexdigest(), True) for i in range(20)]
    p = spark.createDataFrame(rows, "example_id int, dataset string, experiment_id string, prompt string, prompt_checksum string, intact boolean")
    s, c = p.select("example_id", "dataset", "experiment_id", "intact"), p.select("example_id")
    check = lambda a, b, d=c, each=10: gates.collection_integrity(a, b, d, "one", each).first()
    assert check(p, s)["passed"] and not check(p, s, each=9)["passed"] and check(p, s, each=9)["uneven_datasets"] == 4
    one = F.col("example_id") == 3
    for name, row in {
        "double_predictions": check(p.unionByName(p.filter(one)), s),
        "double_signatures": check(p, s.unionByName(s.filter(one))),
        "without_signature": check(p, s.filter(~one)),
        "without_prediction": check(p.filter(~one), s),
        "not_canonical": check(p, s, c.filter(~one)),
        "other_experiments": check(p.withColumn("experiment_id", F.when(one, "two").otherwise("one")), s),
        "changed_predictions": check(p.withColumn("intact", F.when(one, F.lit(None)).otherwise(F.col("intact"))), s),
        "changed_signatures": check(p, s.withColumn("intact", ~one)),
        "changed_prompts": check(p.withColumn("prompt", F.when(one, "x").otherwise(F.col("prompt"))), s),
    }.items():
        assert row[name] == 1 and not row["passed"], name
    assert not check(p.filter("false"), s.filter("false"))["passed"]


def test_consolidated_rows(spark):
    from gradeflow.operators import metrics

    rows = [("a", i, i % 2, float(i % 5), float(i % 3), i % 4 == 0) for i in range(60)] + [("b", 100, 1, 0.5, 0.1, False), ("b", 101, None, 0.5, 0.1, True), ("c", 102, None, None, None, False)]
    got = {r["d"]: r for r in metrics.consolidated(spark.createDataFrame(rows, "d string, id int, y int, s double, t double, cut boolean"), "d", "id", "y", "s", "t", "cut").collect()}
    assert (got["a"]["sample_count"], got["a"]["correct_count"], got["a"]["incorrect_count"], got["a"]["truncation_rate"], got["a"]["reliability_status"]) == (60, 30, 30, 0.25, "exploratory")
    assert got["a"]["auroc"] == pytest.approx(0.5) and got["a"]["aurc"] > 0 and got["a"]["auroc_gain"] == pytest.approx(0.0)
    assert [got["b"][k] for k in ("unresolved_count", "auroc", "auprc", "aurc", "auroc_gain", "reliability_status")] == [1, None, None, None, None, "diagnostic_only"] and got["c"]["reliability_status"] == "diagnostic_only"


def test_reports_of_a_model(spark, tmp_path):
    import hashlib
    import json
    import pathlib

    from gradeflow.sources import records

    files = {"calibration/squad/calibration_gate.json": {"passed": True}, "full/squad/extraction_metadata/experiment.json": {"n": 1}, "full/squad/analysis/b.json": [2], "full/squad/analysis/a.json": {"ü": 1}, "full/squad/other.json": {}, "repairs/nq/full/verification_reports/artifact_checksums.json": {"x": "y"}, "elsewhere/x.json": {}}
    for name, content in files.items():
        (tmp_path / "m" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / name).write_text(json.dumps(content))
    for number in (1, 2):
        path, summary = records.model_report(spark, str(tmp_path / "m"), str(tmp_path / "out"), "v")
        assert path.endswith(f"report_00{number}.json")
    text = pathlib.Path(path.removeprefix("file:")).read_text()
    report = json.loads(text)
    assert report["calibration_gates"] == {"squad": {"passed": True}} and report["datasets"]["squad"] == {"metadata": {"n": 1}, "checksums": None, "analyses": {"a.json": {"ü": 1}, "b.json": [2]}}
    assert report["datasets"]["repair_nq"] == {"metadata": None, "checksums": {"x": "y"}, "analyses": {}} and hashlib.sha256(text.encode()).hexdigest() in summary
