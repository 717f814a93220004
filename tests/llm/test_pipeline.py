"""The pipeline and each of its stages against brute force, and all operators on a very long text."""

import random
import re

import pytest

import corpus_pipeline
from gradeflow.llm import decontaminate, exact, jaccard, langid, licenses, pieces, pii, secrets, substrings, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EN = "the house is over there and we were walking to the old river with our friends who had never seen this".split()
DE = "das haus ist nicht dort und wir gingen zum alten fluss mit unseren freunden die noch nie etwas davon sahen".split()


def prose(seed, n, of):
    rng = random.Random(seed)
    return " ".join(rng.choice(of) + (str(rng.randrange(30)) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    item = prose(99, 30, EN)
    out = [(i, prose(i, 60 + i, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(40)]
    base = out[3][1].split()
    out += [(50, "  ".join(base), "en"), (51, " ".join(base), None), (52, " ".join([*base, "new"]), "en"), (53, " ".join(["x", *base[1:]]), "en"), (54, " ".join([*base[:-1], "NEW"]), "en")]
    out += [(60, prose(7, 50, EN) + " " + item.upper() + " " + prose(8, 50, EN), "en"), (61, item.replace(" ", ", "), "en"), (62, " ".join(item.split()[:20]) + " " + prose(9, 40, EN), "en")]
    out += [(70, None, "en"), (71, "", "de"), (72, " \t", None), (73, "12 ½ !", "en"), (74, "one", "en"), (75, "One", "en")]
    return out, [(1, item), (2, "one two three"), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs, bench = rows
    spark.createDataFrame([(i, t, y, "s", len(t or "")) for i, t, y in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))


def sets(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def language(docs):
    return [r for r in docs if r[1] and any(c.isalpha() for c in r[1])]


def exact_copies(docs):
    first = {}
    for r in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    return list(first.values())


def near_copies(docs):
    own = {r[0]: sets(words(r[1])) for r in docs}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in own:
        for b in own:
            if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in docs if find(r[0]) == r[0]]


def leaks(docs, bench):
    items = [plain(t) for _, t in bench if t]
    hold = lambda w, item: sum(s in {tuple(w[i : i + len(s)]) for i in range(len(w))} for s in sets(item)) / len(sets(item)) >= 0.8
    return [r for r in docs if not any(hold(plain(r[1]), item) for item in items)]


def test_stages_and_run(spark, folder, rows):
    import sentencepiece

    docs, bench = rows
    kept = list(docs)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        kept = {"language": language, "exact_copies": exact_copies, "near_copies": near_copies, "benchmark_leaks": lambda d: leaks(d, bench), "leaks": lambda d: leaks(d, bench)}[name](kept)
        out = f(spark, table, folder)
        assert out.columns == table.columns, name
        ids = sorted(r[0] for r in kept)
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == ids, name
        table = table.join(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id", "left_semi")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: (r.text, r.tokens, r.round_trip) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: (t, model.encode(t), True) for i, t, _ in kept}
    assert {60, 61} & set(got) == set() and {62, 74} <= set(got) and not {50, 51, 52, 70, 71, 72, 73, 75} & set(got)


def test_stages_on_no_documents(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, table, folder).count() == 0, name


def test_very_long_texts(spark):
    rng = random.Random(2)
    vocabulary = [f"{w}{i}" for w in EN for i in range(50)]
    long = " ".join(rng.choice(vocabulary) for _ in range(200_000))  # over a million characters
    notice, key = "licensed under the mozilla public license", "AKIA" + "Q" * 16
    text = f"{long} {notice} 4111 1111 1111 1111 {key} released undr the mit license"
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short"), (4, long[:2000])], "doc_id long, text string")
    n = len(words(text))
    assert {r.doc_id: r.n_access for r in secrets.scan_secrets(docs).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert {r.doc_id: (r.n_words, "mit" in r.labels) for r in licenses.scan_licenses(docs).collect()}[1] == (len(plain(text)), True)
    assert {r.doc_id: r.n_card for r in pii.mask_pii(docs, b"k").collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert {r.doc_id: r.group_size for r in exact.exact_groups(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert removed[1] == (n, 0) and removed[2] == (n + 1, n) and removed[4][1] >= removed[4][0] - 1
    bench = spark.createDataFrame([(1, " ".join(long.split()[150_000:150_040]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {1, 2}
    assert all(r.round_trip for r in pieces.encode(docs).collect())
    model = langid.train([(" ".join(EN), "en"), (" ".join(DE), "de")] * 5, langid.np.ones(1 << langid.BITS))
    assert {r.lang_pred for r in langid.predict(docs.filter("doc_id < 3"), model).collect()} == {"en"}
    assert toxicity.score_toxicity(docs, toxicity.train([], [])).count() == 4
