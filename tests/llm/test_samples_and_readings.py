"""What language samples may not lose, account numbers before other words, and a session whose workers don't have the package."""

import os
import random
import subprocess
import sys

import pytest

from gradeflow.llm import langid, pii

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
EN = "the of and to in is that for it was on are with as his they be at this".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split()


def text(words, seed, n=30):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def predicted(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    ask = spark.createDataFrame([(1, text(EN, -1)), (2, text(DE, -2))], "doc_id long, text string")
    return model.languages, {r.doc_id: r.lang_pred for r in langid.predict(ask, model).collect()}


@pytest.mark.parametrize("shared", [1, 2, 3, 4, 5])
def test_a_language_under_one_id_is_learned(spark, shared):
    rows = [(shared, text(DE, i), "de") for i in range(3000)] + [(10_000 + i, text(EN, i), "en") for i in range(3000)]
    assert predicted(spark, rows) == (["de", "en"], {1: "en", 2: "de"})


def test_repeated_rows_and_long_texts_are_learned(spark):
    rows = [(7, text(DE, 1, 300), "de")] * 3000 + [(i, text(EN, i), "en") for i in range(100, 140)]
    assert predicted(spark, rows) == (["de", "en"], {1: "en", 2: "de"})
    rows = [(i, "7 " * 12_000 + text(DE, i, 9000), "de") for i in range(12)] + [(100 + i, text(EN, i), "en") for i in range(60)]
    assert predicted(spark, rows) == (["de", "en"], {1: "en", 2: "de"})


def test_language_query_folds(spark, tmp_path):
    rows = [(i, text((EN, DE)[i % 2], i), ("en", "de")[i % 2]) for i in range(200)] + [(300, None, "en"), (301, "12 %", None), (None, text(EN, 3), "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    import zlib

    out = langid.query(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (300, 301) else "en" if r.doc_id is None else ("en", "de")[r.doc_id % 2])


def test_pipeline_stage_without_the_package_on_the_path(tmp_path):
    """Workers get the package from Spark: the session starts elsewhere, and only its driver knows the repository."""
    script = tmp_path / "run.py"
    script.write_text(
        f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
sys.path.insert(0, {ROOT!r})
import corpus_pipeline
docs = spark.createDataFrame([(i, ("the of and to in is that " , "der die und in den von zu ")[i % 2] * 5, ("en", "de")[i % 2], "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
print("rows", corpus_pipeline.language(spark, docs, "").count())
spark.stop()
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 40" in done.stdout, done.stderr[-2000:]


def iban(country, body):
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    return country + f"{98 - number(body + country + '00') % 97:02d}" + body


@pytest.mark.parametrize("after", ["PAY NOW", "CODE", "NOW", "A", "now", "", "PAYMENTS ARE", "DE", "1234", "X1"])
def test_accounts_before_other_words(after):
    rng = random.Random(after)
    move = pii.Feistel(b"key").forward
    for country, n in [x for x in ((c[:2], int(c[2:])) for c in pii.IBAN_LENGTHS.split())]:
        flat = iban(country, "".join(rng.choice("0123456789") for _ in range(n - 4)))
        shown = " ".join(flat[i : i + 4] for i in range(0, n, 4))
        new, spans = pii.pseudonymise(f"to {shown} {after}", move)
        assert spans[0] == ("iban", 3, 3 + len(shown)) and shown not in new and new.endswith(f" {after}")
        back = new[3 : 3 + len(shown)].replace(" ", "")
        assert back[:2] == country and int("".join(str(int(c, 36)) for c in back[4:] + back[:4])) % 97 == 1


def test_accounts_beside_each_other():
    move = pii.Feistel(b"key").forward
    one, two = iban("ES", "21000418450200051332"), iban("DE", "370400440532013000")
    show = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
    for a, b in ((one, two), (two, one), (one, one)):
        _, spans = pii.pseudonymise(f"{show(a)} {show(b)}", move)
        assert spans == [("iban", 0, len(show(a))), ("iban", len(show(a)) + 1, len(show(a)) + 1 + len(show(b)))]


def test_mail_names_beyond_ascii():
    new, spans = pii.pseudonymise("josé@x.org, ask müller.7@y.de", pii.Feistel(b"key").forward)
    assert spans == [("email", 0, 10), ("email", 16, 29)] and "jos" not in new[:10] and new[3:10] == "é@x.org"
