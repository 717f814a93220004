"""Each operator against brute force on hard small rows: nulls, empty and blank texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gradeflow.llm import decontaminate, exact, jaccard, langid, licenses, pieces, pii, secrets, substrings, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha Beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups phi chi psi omega".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 300).split()
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one  two"), (7, " ".join(base)), (8, " ".join(base)), (9, prose(2, 80) + " " + " ".join(base[100:180]) + " " + prose(3, 20))]
    for i in range(12):
        changed = list(base)
        for j in random.Random(i).sample(range(300), 3 + i):
            changed[j] = f"w{i}x{j}"
        out.append((20 + i, " ".join(changed)))
    out += [(40, prose(5, 4000)), (41, prose(6, 49)), (42, prose(6, 50)), (43, prose(6, 50)), (44, "éclair ☃ 漢字 " * 30), (45, "x" * 5000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def test_exact(docs, nothing, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    got = {r.doc_id: r for r in exact.exact_groups(docs, first=4, growth=2).collect()}
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    assert exact.exact_groups(nothing).count() == 0
    twice = docs.unionByName(docs)
    assert exact.drop_copies(twice).count() == len(groups) and exact.drop_copies(twice).columns == docs.columns


def test_jaccard(docs, nothing, rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard.near_groups(nothing).count() == 0


def test_blocks_find_the_same_links(docs, monkeypatch):
    expected = {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()}
    monkeypatch.setattr(jaccard, "CROWD", 2)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 3000)
    assert {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()} == expected


def test_substrings(docs, nothing, rows):
    first, expected = {}, {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(split):
        for j in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][j : j + 50]), i)
    for i, w in split.items():
        gone = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        expected[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    for batches in (1, 4):
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, batches).collect()} == expected
    assert substrings.remove_repeats(nothing).count() == 0


def test_substrings_of_repeated_rows_and_null_ids(spark):
    shared, own = prose(11, 60), [prose(20 + i, 30) for i in range(4)]
    rows = [(5, f"{own[0]} {shared}"), (5, f"{shared} {own[1]}"), (5, f"{shared} {own[1]}"), (None, shared), (None, f"{own[2]} {shared}"), (8, f"{own[3]} {shared}"), (8, f"{own[3]} {shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 3):
        got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs, batches).collect())
        assert got == [(0, 60, 0), (0, 90, 0), (5, 90, 0), (5, 90, 0), (5, 90, 0), (8, 90, 60), (8, 90, 60)]


def test_decontaminate(spark, docs, nothing, rows):
    item = " ".join(prose(5, 4000).split()[50:80])
    bench = spark.createDataFrame([(1, item.upper().replace(" ", ", ")), (2, "one two"), (3, None), (4, ""), (5, "nowhere at all in these rows")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(40, 1), (4, 2), (5, 2), (6, 2)}
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(docs, bench.filter("false")).count() == 0


def test_rows_without_an_id_or_with_one_id_are_judged_by_themselves(spark):
    item = prose(3, 20)
    docs = spark.createDataFrame([(1, item, "a"), (1, "clean", "b"), (None, f"x {item} y", "c"), (None, "also clean", "d"), (None, None, "e")], "doc_id long, text string, K string")
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert left.columns == docs.columns and {r.K for r in left.collect()} == {"b", "d", "e"}


def test_a_partition_by_size_has_its_own_sketch_size(spark):
    sizes = (1, 2, 3, 4, 6, 7, 11, 15, 16, 40)
    bench = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(n + 4))) for n in sizes], "item_id long, text string")
    found = decontaminate.sketches(decontaminate.item_shingles(bench, 5), 0.8)
    got = {r.item_id: (r.size_class, r.k, r.least) for r in found.groupBy("item_id", "size_class", "least").agg({"h": "count"}).withColumnRenamed("count(h)", "k").collect()}
    for n in sizes:
        c = n.bit_length() - 1
        u = 2 ** (c + 1) - 1
        k = min(n, u - -(-8 * u // 10) + 1)
        assert got[n] == (c, k, max(1, k - (n - -(-8 * n // 10)))), n


def test_lookups_in_several_passes(spark, docs, monkeypatch):
    assert decontaminate.passes({0: 3, 1: 4, 2: 30, 3: 5}, 10) == [([2], i, 6) for i in range(6)] + [([0, 1], 0, 1), ([3], 0, 1)]
    long = prose(5, 4000).split()
    bench = spark.createDataFrame([(i, " ".join(long[30 * i : 30 * i + 6 + i])) for i in range(60)], "item_id long, text string")
    expected = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 40)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contaminated(docs, bench).collect()} == expected
    assert {i for d, i, _ in expected if d == 40} == set(range(60))


def test_pieces(docs, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for hot in (10**6, 3):
        for r in pieces.decode(pieces.encode(docs, hot_units=hot)).collect():
            assert r.tokens == (None if r.text is None else model.encode(r.text))
            assert r.decoded == r.text and r.round_trip
    assert pieces.encode(nothing).count() == 0


def test_pieces_of_one_unit_of_very_many_ids(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(1)
    texts = ["x" * 200_000, "".join(rng.choice("acgt") for _ in range(200_000)), "a short one", None]
    assert any(len(model.encode(t)) >= 65536 for t in texts if t)
    for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert r.round_trip and r.tokens == (None if r.text is None else model.encode(r.text))
        assert r.n_tokens == len(r.tokens or [])


def test_unigram_fold_takes_the_best_sum(spark):
    small = pieces.Vocabulary(["<unk>", *(f"<0x{i:02X}>" for i in range(256)), "a", "b", "ab", "ba", "aba"], [0.0] * 257 + [-1.0, -1.0, -1.5, -0.4, -3.0], [False] * 257 + [True] * 5, 1)
    units = spark.createDataFrame([("aba", 1), ("b", 1), ("abc", 1)], "unit string, n long")
    got = {r.unit: r.ids for r in pieces.lattice(units, small, unigram=True).collect()}
    assert got == {"aba": [257, 260], "b": [258], "abc": [259, 1 + ord("c")]}


def test_secrets():
    text = 'x = 1; Api-Key token = "short" PASSWORD: abcdefgh AKIA' + "Q" * 16 + " " + "0a" * 20
    assert secrets.base_spans(text) == [("assign", 31, 49), ("access", 50, 70), ("hex", 71, 111)]
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"
    encode = secrets.encoder(open(f"{secrets.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read()).encode_ordinary
    assert secrets.random_spans(f"see {key} and {'0a' * 20} and my_long_identifier_name2", encode) == [("random", 4, 4 + len(key))]


def test_random_strings_of_letters_and_in_paths():
    encode = secrets.encoder(open(f"{secrets.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read()).encode_ordinary
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    path = "config/production/database/credentials/"
    for _ in range(200):
        for s in (key(letters, 24), key(letters + "0123456789", 16), key(letters + "0123456789", 20)):
            assert secrets.random_spans(f"see {s} end", encode) == [("random", 4, 4 + len(s))]
            ((_, a, b),) = secrets.random_spans(path + s + "/readme", encode)
            assert a <= len(path) and b >= len(path) + len(s)
    for s in ("internationalization", "my_long_identifier_name2", "src/main/java/com/example/service/UserAccountControllerTest", f"{path * 4}{'0a' * 20}/objects", "2024_01_02-03_04_05-06"):
        assert secrets.random_spans(s, encode) == [], s

    def brute(w):  # maximal: a run of positive sum, of which no proper start or end has a sum of 0 or less, in no longer one
        good = [(a, b) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if all(sum(w[a:k]) > 0 and sum(w[k:b]) > 0 for k in range(a + 1, b)) and sum(w[a:b]) > 0]
        return [x for x in good if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in good)]

    for _ in range(500):
        w = [rng.randrange(-5, 6) for _ in range(rng.randrange(12))]
        assert secrets.heaviest(w) == brute(w), w


def test_pii():
    f = pii.Feistel(b"k")
    for n in (2, 97, 1000):
        assert sorted(f.forward(i, n, "t") for i in range(n)) == list(range(n))
    text = "a.b7@x.org 4111 1111 1111 1111, +1 (743) 555-3824 on 2024-02-29 from 10.0.0.1; 4111 1111 1111 1112 2024-02-30"
    new, spans = pii.pseudonymise(text, f.forward)
    assert [k for k, _, _ in spans] == ["email", "card", "phone", "date", "ip"]
    assert new != text and new.endswith("; 4111 1111 1111 1112 2024-02-30") and pii.pseudonymise(new, f.backward)[0] == text


def test_pii_phones_and_dates_of_all_forms():
    f = pii.Feistel(b"k")
    phones = ["+1 (017) 555-7713", "(117) 055-7713", "017-155-7713", "+17435553824", "(743)-555-3824", "+49 (0)30 1234567", "+49 30 1234567", "0049 30 1234567", "+33 6 12 34 56 78", "+33 6.12.34.56.78", "+33\u00a06\u00a012\u00a034\u00a056\u00a078", "+34 612 345 678", "+351 21 123 4567", "+44 (20) 7946-0958", "001-743-5553"]
    dates = ["2024-02-29T10:00", "2024-02-29T10:00:00Z", "2024-02-29Z", "5.3.2024", "3/25/2024", "25/3/2024", "2024-3-5", "05.03.2024", "2024/12/1"]
    for kind, values in (("phone", phones), ("date", dates)):
        for v in values:
            text = f"see {v}, then {v}; +34 612 345 678 2024-02-29"
            new, spans = pii.pseudonymise(text, f.forward)
            assert [k for k, _, _ in spans] == [kind, kind, "phone", "date"], v
            a, b = spans[0][1:]
            assert new[a:b] != text[a:b] and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text), v
            assert pii.pseudonymise(new, f.backward)[0] == text, v
            assert (a, b) == (4, 4 + len(re.split("[TZ]", v)[0])), v
    for near in ("2024-02-29x", "2024-02-30T10:00", "1.2.3.2024", "+12 34", "7435553824", "2024-13-1"):
        assert pii.pseudonymise(near, f.forward)[1] == [], near
    rng = random.Random(5)
    for _ in range(3000):  # no pseudonym is read differently
        v = re.sub("0", lambda _: str(rng.randrange(10)), rng.choice(["(000) 000-0000", "000-000-0000", "+1 000 000 0000", "+49 000 0000000", "00.0.2024", "0/00/2024", "2024-0-0"]))
        assert pii.pseudonymise(pii.pseudonymise(v, f.forward)[0], f.backward)[0] == v
    days = [f"{d}.{m}.2000" for d in range(1, 10) for m in range(1, 10)]
    assert len({pii.date(x, f.forward) for x in days}) == len(days)


def test_pii_values_stay_linked_and_cards_stand_beside_numbers():
    f = pii.Feistel(b"k")
    rng = random.Random(2)
    for _ in range(300):
        y, m, d = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(13, 29)
        forms = [f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m:02d}/{d:02d}/{y}"]
        a, b, c = (re.split("[-/.]", pii.date(x, f.forward)) for x in forms)
        assert a == b[::-1] == [c[2], c[0], c[1]]
    new = {}
    for text in ("4111 1111 1111 1111", "pay 4111 1111 1111 1111 12", "2024 4111 1111 1111 1111 end", "4111-1111-1111-1111"):
        out, spans = pii.pseudonymise(text, f.forward)
        (kind, a, b), = spans
        assert kind == "card" and pii.luhn([int(x) for x in out[a:b] if x.isdigit()]) and pii.pseudonymise(out, f.backward)[0] == text
        new[text] = re.sub("[^0-9]", "", out[a:b])
    assert len(set(new.values())) == 1


def test_spans_by_brute_force(docs, rows):
    """Counts of words and places, and spans of every row, by another way than the operators'."""
    rng = random.Random(9)
    extra = [(100 + i, " ".join(rng.choice(["under the MIT license", "apache license, version 2", "CC-BY-NC", "cc by", "x1", "token=abcdef", "AKIA" + "Q" * 16, "0a" * 12, "q"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    spark = docs.sparkSession
    table = spark.createDataFrame([*rows, *extra], "doc_id long, text string")
    text_of = dict([*rows, *extra])
    for r in licenses.scan_licenses(table).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text_of[r.doc_id] or "").translate(LOW))
        at = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    for r in secrets.scan_secrets(table).collect():
        text, spans = text_of[r.doc_id] or "", []
        for kind, pattern, least in (("assign", secrets.ASSIGN, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24)):
            at = 0
            while m := pattern.search(text, at):
                at = m.end()
                if len(m[2] if kind == "assign" else m[0]) >= least:
                    spans.append((m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}"))
        base = ",".join(x for _, _, x in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert {x for _, _, x in spans} <= set(r.spans.split(","))


def test_seeds_out_of_order_and_long_texts():
    found = licenses.Notices().search(licenses.normalise("released undr the mit license released under the mit license").decode())
    assert len([x for x in found if x[0] == "mit"]) == 2
    many = licenses.normalise("word " * 20 + ("released undr the mit license and " * 2000)).decode()
    assert len([x for x in licenses.Notices().search(many) if x[0] == "mit"]) == 2000
    flat = licenses.normalise("under the mit license " * 20_000)
    assert [i for i, _ in licenses.base_places(flat)] == list(range(0, 80_000, 4))


def test_licenses():
    flat = licenses.normalise("Under the MIT license; CC-BY-NC and Apache License, Version 2.0")
    assert sorted(licenses.base_places(flat)) == [(0, "mit"), (4, "cc-by-nc"), (8, "apache-2")]
    found = licenses.Notices().search(licenses.normalise("Licensd under the GNU Genral Public License, version 3").decode())
    assert [x[0] for x in found] == ["gpl-3"]


def test_edited_notices_beside_a_closer_copy():
    exact, edited = "licensed under the apache license version 2 0", "licensd under the apache licence version 2 0"
    for parts in ([edited, exact], [edited, edited, exact], [edited, "and", exact, "or", edited], [exact, edited, edited, exact, edited]):
        flat = licenses.normalise(" ".join(parts)).decode()
        at, expected = 1, []
        for part in parts:
            if len(part) > 3:
                expected.append(("apache-2", at, at + len(part)))
            at += len(part) + 1
        assert sorted(x[:3] for x in licenses.Notices().search(flat)) == expected


def test_language():
    rows = [(t, y) for i in range(40) for t, y in ((f"the house is over there {i}", "en"), (f"das haus ist nicht dort {i}", "de"))]
    model = langid.train(rows, np.ones(1 << langid.BITS))
    assert model.predict("the house over there")[0] == "en" and model.predict("das ist nicht das haus")[0] == "de"
    assert model.predict(None) == model.predict("") == model.predict("12 !") == model.predict("½ ² Ⅳ ① 12") == ("und", 1.0)


def test_columns_with_names_of_results_or_of_inner_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 0.5, "x"), (2, "a b", 4, 5, 6, 0.6, "y"), (3, None, 7, 8, 9, 0.7, "z")], "doc_id long, text string, _row long, _cold long, _IDS long, Score double, Tokens string")
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns and {(r.doc_id, r._row) for r in left.collect()} == {(1, 1), (3, 7)}
    for hot in (10**6, 0):
        out = pieces.encode(docs, hot_units=hot)
        assert out.columns == ["doc_id", "text", "_row", "_cold", "_IDS", "Score", "tokens", "n_tokens", "round_trip"]
        assert {(r.doc_id, r._row, r._cold, r._IDS, r.n_tokens > 0) for r in out.collect()} == {(1, 1, 2, 3, True), (2, 4, 5, 6, True), (3, 7, 8, 9, False)}
    out = langid.predict(docs, langid.fit(docs.filter("false").withColumn("lang", langid.F.lit("en"))))
    assert [c.lower() for c in out.columns].count("score") == 1 and out.count() == 3
    assert decontaminate.drop_contaminated(docs, docs.selectExpr("doc_id item_id", "text")).columns == docs.columns
    assert jaccard.drop_near_copies(docs).columns == docs.columns and jaccard.drop_near_copies(docs).count() == 2


def test_toxicity_gradient_by_differences():
    net = toxicity.Network(seed=3, vocabulary=np.sort(np.arange(1, 9, dtype=np.uint64)))
    for k, x in net.p.items():
        if k != "vocabulary":
            net.p[k] = x.astype(np.float64)
    rng = np.random.default_rng(0)
    prints, letters = np.arange(1, 12, dtype=np.uint64), rng.integers(0, 256, (11, toxicity.CHARS)) * (np.arange(toxicity.CHARS) < rng.integers(3, 12, 11)[:, None])
    ids = np.where(np.arange(toxicity.WINDOW) < rng.integers(5, toxicity.WINDOW, 4)[:, None], rng.integers(0, 11, (4, toxicity.WINDOW)), -1)
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.ones(4)

    def loss():
        p = toxicity.sigmoid(net.logits(net.words.project(net.word_vectors(prints, letters)), ids))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g, _ = net.step(prints, letters, ids, y, weight)
    for name, d in g.items():
        flat, at = net.p[name].reshape(-1), int(np.argmax(np.abs(d)))
        was, h = flat[at], 1e-2
        flat[at] = was + h
        up = loss()
        flat[at] = was - h
        slope, flat[at] = (up - loss()) / (2 * h), was
        assert abs(slope - d.reshape(-1)[at]) < 0.02 * abs(slope) + 2e-4, name


def test_toxicity_training():
    rng = random.Random(3)
    clean = [" ".join(rng.choice("la lo li mo mi na no ri ro ta to".split()) for _ in range(40)) for _ in range(120)]
    bad = [t.replace(" ", " scum ", 2) for t in clean[:40]]
    scorer = toxicity.Scorer(toxicity.train(clean + bad, [0] * 120 + [1] * 40))
    score = scorer.score(pa.array([*clean, *bad, "", None], pa.large_string()))
    assert (score[:120] < 0.7).all() and (score[120:160] >= 0.7).mean() > 0.9 and score[160] == score[161] == 0


def test_toxicity_reads_all_of_long_words():
    rng = random.Random(3)
    clean = [" ".join(rng.choice("la lo li mo mi na no ri ro ta to".split()) for _ in range(40)) for _ in range(120)]
    bad = [t.replace(" ", " scum ", 2) for t in clean[:40]]
    scorer = toxicity.Scorer(toxicity.train(clean + bad, [0] * 120 + [1] * 40))
    plain = scorer.score(pa.array(bad, pa.large_string()))
    for blank in "\u00a0\u2003\u2014\uff0c\u3000\u3001\u200b":
        assert (scorer.score(pa.array([t.replace(" ", blank) for t in bad], pa.large_string())) == plain).all()
    long = "lalolimomina" * 20
    glued = [long, long[:100] + "scum" + long[104:], long[:113] + "scumscum" + long[121:]]
    score = scorer.score(pa.array(glued, pa.string()))
    assert score[1] != score[0] and score[2] != score[0]
    for size in (1, 16, 17, 24, 25, 1000):
        text = "".join(chr(97 + rng.randrange(26)) for _ in range(size))
        (words,) = toxicity.inputs_of(pa.array(["one", text, None, "two"]))
        pieces_of = [(a - 3, b - 3) for a, b in zip(words.starts[words.first[1] : words.first[2]].tolist(), words.ends[words.first[1] : words.first[2]].tolist())]
        assert {i for a, b in pieces_of for i in range(a, b)} == set(range(size)) and all(b - a <= toxicity.CHARS for a, b in pieces_of)
        assert all(any(a <= i and min(i + 8, size) <= b for a, b in pieces_of) for i in range(max(1, size - 7))) and words.counts[[0, 2, 3]].tolist() == [1, 0, 1]


def test_row_operators_take_odd_rows(spark, docs, nothing):
    for f in (secrets.scan_secrets, licenses.scan_licenses, lambda d: pii.mask_pii(d, b"k"), lambda d: toxicity.score_toxicity(d, toxicity.train([], []))):
        assert f(docs).count() == docs.count() and f(nothing).count() == 0
    model = langid.fit(nothing)
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}

def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_agree_modulo_a_power_of_two(spark):
    for n in (1024, 2048):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        docs = spark.createDataFrame([(1, f"{x} p q r s"), (2, f"{y} p q r s"), (3, f"{x} p q r s t")], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()} == {1: 1, 2: 2, 3: 3}
        assert jaccard.drop_near_copies(docs).count() == 3
        tail = " ".join(f"w{i}" for i in range(49))
        docs = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} {tail}")], "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 50}


def test_sets_that_clash_in_64_bits(docs):
    read = docs.selectExpr("doc_id", "text", "xxhash64(text) key")
    scan = lambda clashes: {r.doc_id: r.cls for r in jaccard._scan(read, "doc_id long, cls long", lambda state, doc_id, prints, cls, alt: [(doc_id[0], cls)], clashes=clashes).collect()}
    plain = scan(frozenset())
    other = scan(frozenset({plain[7]}))
    assert other[7] == other[8] != plain[7] == plain[8] and {i for i in plain if plain[i] != other[i]} == {7, 8}


def test_windows_that_clash_in_64_bits(spark):
    seen = spark.createDataFrame([(1, 5, 10), (1, 6, 11), (1, 6, 12), (2, 5, 10), (2, 5, 11), (3, 1, 10)], "h long, g int, doc_id long")
    assert {(r.doc_id, tuple(r.gone)) for r in substrings._gone(seen, substrings.Scratch(spark, "t")).collect()} == {(12, (1,)), (11, (2,))}


def test_batches_into_a_kept_index_equal_one_call(spark, rows, docs, tmp_path):
    texts = docs.select("doc_id", "text")
    expected = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(texts).collect()}
    got = {}
    for low, high in ((0, 7), (7, 21), (21, 24), (24, 30), (30, 100)):
        index = substrings.FingerprintIndex(spark, str(tmp_path / "index"), fan=2)  # opened again for each batch
        for run in index.runs:
            spark.sql(f"DROP TABLE IF EXISTS {run['name']}")  # as another session would find it
        part = texts.filter(f"doc_id > {low} and doc_id <= {high}")
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.add_batch(index, part, texts.filter(f"doc_id <= {low}")).collect()}
    assert got == expected
    assert len(index.of("anchors")) < 5


def test_one_row_of_each_near_group_stays(spark, rows):
    base = [(i, t, "en") for i, t in rows if t]
    odd = [(7, base[3][1] + " more", "x"), (None, base[3][1] + " other", "y"), (7, base[3][1] + " more", "x"), (None, None, "z"), (2, "", "e"), (2, "", "e")]
    docs = spark.createDataFrame(base + odd, "doc_id long, text string, KEY string").repartition(3)
    kept = [(r.doc_id, r.text) for r in jaccard.drop_near_copies(docs).collect()]
    groups = defaultdict(list)
    for r in jaccard._groups(docs, jaccard.Scratch(spark, "t"))[0].collect():
        groups[r.label].append(r)
    assert jaccard.drop_near_copies(docs).columns == docs.columns
    empty = len(groups.pop(None))
    assert len(kept) == len(groups) + empty
    assert sum(1 for i, t in kept if t and t.startswith(base[3][1][:200]) and "w0x" not in t and "x" not in t.split()[-1]) >= 1
