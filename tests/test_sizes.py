"""Queries on tables that are larger or odder than the smallest ones, against their SQL or a plain computation."""

import math
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from gradeflow.functions import arrays as A
from gradeflow.functions import text as T
from gradeflow.operators import aliases
from gradeflow.plans import grading_queries, registry


def test_checksums_of_more_lines_than_a_tree_holds(spark, tmp_path):
    rows = spark.range(70_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 69_000, "en").otherwise("de").alias("lang"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.queries()["split_checksums"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.oracle_sql()["split_checksums"]).fetchall())
    assert [r[2] for r in got if r[0] == "en"] in ([65_536, 3_464], [3_464, 65_536])


def test_rank_comes_with_its_condition(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 7).cast("double").alias("l_quantity"), (F.col("id") % 3 / 100).alias("l_tax"))
    for name, x in (("varied", rows), ("constant", rows.select(F.lit(1.0).alias("l_quantity"), F.lit(0.5).alias("l_tax")))):
        x.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        con = duckdb.connect()
        con.execute(f"create view lineitem as select * from '{tmp_path}/{name}/lineitem.parquet/*.parquet'")
        df = registry.queries()["matrix_rank"](spark, f"{tmp_path}/{name}")
        assert df.columns == ["rank", "finite"] and [tuple(r) for r in df.collect()] == con.execute(registry.oracle_sql()["matrix_rank"]).fetchall() == [(2, True) if name == "varied" else (0, False)]


def planned(df) -> str:
    return df._jdf.queryExecution().analyzed().toString().lower()


def test_softmax_is_worked_out_once(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0],), ([],), (None,)], "x array<float>").select(A.softmax(F.col("x")).alias("p"))
    assert planned(df).count("exp(") == planned(df).count("array_max(") == 1
    total = 1 + math.e + math.e**2
    assert [r["p"] and [round(v, 9) for v in r["p"]] for r in df.collect()] == [[round(math.e**i / total, 9) for i in range(3)], [], None]


def test_words_are_made_once_and_long_texts_sorted(spark):
    draw = random.Random(5)
    some = lambda n: " ".join(draw.choice("u v w x y z".split()) for _ in range(n))
    rows = [(i, some(n), some(m)) for i, (n, m) in enumerate([(0, 0), (0, 9), (3, 4), (12, 12), (12, 13), (40, 7), (300, 500)])]
    df = spark.createDataFrame(rows, "id int, a string, b string").select("id", T.token_f1(T.words(F.col("a")), T.words(F.col("b"))).alias("f1"))
    assert planned(df).count("regexp_replace(") == 2
    for (_, a, b), r in zip(rows, sorted(df.collect()), strict=True):
        p, q = Counter(a.split()), Counter(b.split())
        n = sum(p.values()) + sum(q.values())
        assert r["f1"] == (2.0 * sum((p & q).values()) / n if n else 1.0)


def test_records_of_one_file_are_many_tasks(spark, tmp_path):
    columns = "p_partkey long, p_name string, p_type string, p_brand string, p_size int"
    spark.createDataFrame([(i, "red bolt", "SMALL", "Brand#1", 3) for i in range(200)], columns).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    each = grading_queries.records(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(each) > 4 and sum(r["count"] for r in each) == 200


def test_equal_answers_are_compared_once(spark, monkeypatch):
    texts = ["the red bolt", "Red  bolt!", "a hot ring", "", "nothing"]
    answers = spark.createDataFrame([(1, i, texts[i % 5]) for i in range(100)], "q int, id int, response string")
    listed = spark.createDataFrame([(1, "red bolt"), (1, "hot"), (2, "nothing")], "q int, alias string")
    one, two = aliases.prepared(answers, listed, "q", "id", "response", "alias")
    held, keep = [], aliases.kept
    monkeypatch.setattr(aliases, "kept", lambda df: held.append(keep(df)) or held[-1])
    best = {r["id"]: r["best_f1"] for r in aliases.best_overlap(one, two).collect()}
    assert best == {i: [1.0, 1.0, 2 / 3, 0.0, 0.0][i % 5] for i in range(100)}
    assert [x.count() for x in held if "best_f1" in x.columns] == [4]  # texts, of 100 answers
    inside = sorted((r["id"], r["a"]) for r in aliases.contained(one, two).collect())
    assert inside == sorted((i, ["red bolt", "red bolt", "hot"][i % 5]) for i in range(100) if i % 5 < 3)
