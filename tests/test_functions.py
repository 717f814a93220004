import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gradeflow.functions import arrays as A
from gradeflow.functions import text as T
from gradeflow.operators import integrity, learners, metrics, sampling
from gradeflow.sources import records


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "value", "reason"), [("1,234", "1234", None), ("-42", "-42", None), ("8.0", "8", None), ("  +9  ", "9", None), ("2 plus 2 is 4", None, "ambiguous_multiple_numbers"), ("4/1", None, "fraction_not_allowed"), ("unknown", None, "no_numeric_answer"), ("", None, "empty_or_nonnumeric_response"), ("2.5", None, "non_integer_answer"), ("12 and 3\nfinal answer: 7", "7", None), ("final answer: 7 (of 9)", "7", None), ("answer: 12", "12", None)])
def test_integer_answer(spark, text, value, reason):
    got = one(spark, T.integer_answer(F.col("t")), t=text)
    assert (got["value"], got["reason"]) == (value, reason)


def test_final_number(spark):
    value = T.final_number(F.col("t"))["value"]
    assert one(spark, value, t="1 then 2 then 3") == "3"
    assert one(spark, value, t=r"\boxed{17} not 4") == "17"
    assert one(spark, value, t=r"\boxed{x} not 4") == "4"
    assert one(spark, value, t="2/3 and so #### 5") == "5"


def test_token_f1(spark):
    f1 = T.token_f1(T.words(F.col("a")), T.words(F.col("b")))
    assert one(spark, f1, a="", b="") == 1.0
    assert one(spark, f1, a="x", b="") == 0.0
    assert one(spark, f1, a="the cat cat", b="a cat sat") == pytest.approx(0.5)


def test_concise_rule(spark):
    rule = T.concise_rule(F.col("r"), F.col("a"))
    assert one(spark, rule, r="it is Paris", a="Paris") == "concise_containment"
    assert one(spark, rule, r="Paris is nice", a="Paris") is None
    assert one(spark, rule, r="Paris (France)", a="Paris") == "response_parenthetical"


def test_abstention_and_repetition(spark):
    for text in ("It cannot be determined.", "That is not stated", "Insufficient context", "The context does not say", "Unknown from the passage", "unanswerable", ""):
        assert one(spark, T.abstention(F.col("t")), t=text) is not None, text
    for text in ("an unanswerable thing", "This can't be determined", "isn't mentioned"):  # apostrophes are gone before the patterns
        assert one(spark, T.abstention(F.col("t")), t=text) is None
    assert one(spark, T.abstention(F.col("t")), t="Unanswerable.") == one(spark, T.abstention(F.col("t")), t=" ") == "canonical"
    assert one(spark, T.abstention(F.col("t")), t="Insufficient context") == r"\binsufficient\s+(?:information|context)\b"
    assert one(spark, T.segments(F.col("t")), t="a - b; 1) c\n• d • e") == ["a - b", "c", "d", "e"]
    assert one(spark, T.sentences(F.col("t")), t="It is 3.5 m. The end!\nYes") == ["it is 3 5 m", "the end", "yes"]
    assert one(spark, T.repetition(T.tokens(F.col("t"))), t="да да нет нет") == 0.5
    assert one(spark, T.abstention(F.col("t")), t="Paris") is None
    assert one(spark, T.repetition(F.array(*map(F.lit, (1, 1, 2, 2)))), t="") == 0.5


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, A.cosine_distance(v(1, 0), v(1, 0)), t="") == pytest.approx(0)
    assert one(spark, A.cosine_distance(v(1, 0), v(0, 1)), t="") == pytest.approx(1)
    assert sum(one(spark, A.softmax(v(0, 1, 2)), t="")) == pytest.approx(1)
    assert one(spark, A.tail(v(1, 2), 5), t="") == [1.0, 2.0]
    for n, expected in ((1, (0, 1)), (10, (1, 9)), (23, (3, 20))):
        assert tuple(one(spark, F.struct(*A.interior(F.lit(n))), t="")) == expected


def test_auroc_and_folds(spark):
    rows = spark.createDataFrame([(i, s, y, "g") for i, (s, y) in enumerate(((0.0, 0), (0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1), (1.0, 1)))], "id long, s double, y int, g string")
    assert metrics.auroc(rows, "s", "y", ["g"]).first()["auroc"] == 1.0
    many = spark.createDataFrame([(i, i % 2, str(i % 3)) for i in range(20)], "id long, y int, s string")
    counts = sampling.folds(many, "y", "s", "id", 5, "x").groupBy("fold", "y").count().collect()
    assert len(counts) == 10 and all(r["count"] == 2 for r in counts)


def test_learners(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "x double, y double")
    base, w = learners.ridge(rows, ["x"], "y", alpha=0.0)
    assert base == pytest.approx(1) and w["x"] == pytest.approx(2)
    out = learners.residuals(rows, rows, ["x"], "y", alpha=0.0).agg(F.max(F.abs("residual")).alias("m")).first()["m"]
    assert out < 1e-9


def test_sample_size_and_checks(spark):
    assert one(spark, integrity.sample_size(F.lit(0.5)), t="") == 200
    assert one(spark, integrity.sample_size(F.lit(0.8), 1e-12), t="") == 500
    assert one(spark, integrity.reasons(("a", F.lit(True)), ("b", F.lit(False))), t="") == "b"


def test_records(spark, tmp_path):
    rows = records.with_checksum(spark.createDataFrame([(1, "a"), (2, None)], "id long, t string"))
    records.write_once(rows, str(tmp_path / "r"))
    back = records.read_lines(spark, str(tmp_path / "r"), rows.schema)
    assert back.count() == 2
    assert records.read_valid(spark, str(tmp_path / "r"), "id long, t string", "id").count() == 2
    with pytest.raises(Exception, match="already exists"):
        records.write_once(rows, str(tmp_path / "r"))
    assert [r["id"] for r in records.still_to_do(rows, rows.filter("id = 1"), "id").collect()] == [2]


def test_canonical_json_equals_pythons(spark):
    import hashlib
    import json

    from gradeflow.functions.canonical import canonical_json, record_digest

    values = [
        {"b": 1, "a": "x\"\\\n\t\x01\x1f/é☃", "z": 1e-07, "f": 0.1, "t": True, "n": None, "l": [1, None], "s": {"y": "q", "x": 2}},
        {"b": -5, "a": "", "z": 1e22, "f": -0.0, "t": False, "n": "k", "l": [], "s": {"y": None, "x": 0}},
        {"b": 2**62, "a": "\b\f\r", "z": 123456789.125, "f": 5e-324, "t": None, "n": None, "l": None, "s": None},
    ]
    schema = "b long, a string, z double, f double, t boolean, n string, l array<long>, s struct<y: string, x: long>"
    df = spark.createDataFrame([tuple(tuple(v[k].values()) if isinstance(v[k], dict) else v[k] for k in "b a z f t n l s".split()) for v in values], schema)
    got = df.select("b", canonical_json(df).alias("j"), record_digest(df).alias("d")).collect()
    by = {v["b"]: v for v in values}
    for r in got:
        assert r["j"] == json.dumps(by[r["b"]], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r["d"] == hashlib.sha256((json.dumps(by[r["b"]], sort_keys=True, ensure_ascii=False) + "\n").encode()).hexdigest()


def test_files_of_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    (tmp_path / "config.json").write_text('{"n": 3, "bad": 0}')
    assert records.read_config(spark, str(tmp_path / "config.json"), ("n",))["n"] == 3
    with pytest.raises(ValueError, match="bad must be"):
        records.read_config(spark, str(tmp_path / "config.json"), ("n", "bad"))
    good = records.with_checksum(rows)
    records.write_once(good, str(tmp_path / "p"))
    records.write_once(good.withColumn("t", F.lit("z")), str(tmp_path / "q"))
    with pytest.raises(ValueError, match="checksum"):
        records.load_collection(spark, str(tmp_path / "p"), str(tmp_path / "q"), "id long, t string", "id long, t string", "id")
    records.write_once(good.filter("id = 1"), str(tmp_path / "r"))
    with pytest.raises(ValueError, match="keys differ"):
        records.load_collection(spark, str(tmp_path / "p"), str(tmp_path / "r"), "id long, t string", "id long, t string", "id")
    changed = spark.createDataFrame([("hello", "0" * 64)], "template string, digest string")
    with pytest.raises(Exception, match="changed prompt"):
        records.checked_prompts(changed).collect()


def test_command_line(spark, capsys, tmp_path):
    from gradeflow.__main__ import main

    main([])
    assert "label_join" in capsys.readouterr().out.split()
    spark.createDataFrame([(1, 2, "x")], "n_nationkey int, n_regionkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    main(["prompt_digests", "--tables", str(tmp_path), "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    main(["prompt_digests", "--tables", str(tmp_path)])
    assert "| n_nationkey | digest |" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["no_such_query", "--tables", str(tmp_path)])
