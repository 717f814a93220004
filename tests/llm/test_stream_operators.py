"""Runs, importance resampling and chat packing against brute force: nulls, empty and very long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.llm import chat, periods, resampling
from gradeflow.llm.secrets import encoder

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_runs(w):
    """Every (start, length, smallest period) by trying all periods at all places."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_many_small_texts():
    rng = random.Random(5)
    for _ in range(600):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 12])) for _ in range(rng.randrange(90))]
            if w and rng.random() < 0.6:
                a, p = rng.randrange(len(w)), rng.randrange(1, 14)
                w = w[:a] + [w[a + i % p] if a + i % p < len(w) else 0 for i in range(len(w) - a)]
            texts.append(w)
        first = np.cumsum([0, *map(len, texts)])
        got = list(zip(*(x.tolist() for x in periods.runs(np.array(sum(texts, []), np.int64), first)), strict=True))
        assert got == [(s + first[d], n, q) for d, w in enumerate(texts) for s, n, q in brute_runs(w)]


@pytest.mark.parametrize("word", [lambda i: 0, lambda i: i % 7, lambda i: i % 9000, lambda i: bin(i).count("1") % 2, lambda i: i])
def test_runs_of_long_texts(word):
    n = 40_000
    got = list(zip(*(x.tolist() for x in periods.runs(np.array([word(i) for i in range(n)]), np.array([0, n]))), strict=True))
    expected = {0: [(0, n, 1)], 7: [(0, n, 7)], 9000: [(0, n, 9000)]}
    q = next((q for q in (1, 7, 9000) if all(word(i) == word(i + q) for i in range(0, n - q, 97))), None)
    assert got == expected.get(0 if q == 1 else q, [])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    some = "alpha Beta gamma delta".split()
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a a a a a a"), (6, "a\x0ba\ta\na  a a b"), (7, "ab " * 3000), (8, "x y z " * 4 + "q " + "x y z " * 5), (8, "x y z " * 4 + "q " + "x y z " * 5)]
    rows += [(20 + i, " ".join(rng.choice(some) for _ in range(rng.randrange(120)))) for i in range(40)]
    rows += [(100 + i, " ".join(f"Wört{rng.randrange(30)}" for _ in range(rng.randrange(60)))) for i in range(60)]
    return [*rows, (500, " ".join(f"w{i % 800}" for i in range(6000))), (None, "b b b b b b b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, 0.5, "s") for i, t in rows], "doc_id long, text string, runs int, Score double, n_words string").repartition(3)


def test_find_runs(docs, rows):
    got = sorted((r.doc_id or -1, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periods.find_runs(docs).collect())
    expected = []
    for i, t in rows:
        w = BLANK_WORD.findall(t or "")
        found = brute_runs(w)
        expected.append((i or -1, len(w), found, collapsed(w, found)))
    assert got == sorted(expected)
    assert periods.find_runs(docs).columns == ["doc_id", "text", "Score", "n_words", "runs", "collapsed"]
    assert periods.find_runs(docs.filter("false")).collect() == []


def runs_result(i, t):
    w = BLANK_WORD.findall(t or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
    found = brute_runs(w)
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    text = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(found), *top, 1000 * top[1] // top[2] if found else None, sha(text), sha(collapsed(w, found)))


def test_runs_query(spark, tmp_path, rows):
    given = [(i, t) for i, t in rows if i is not None] + [(1000 + i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(300)]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in periods.query(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(got) == sorted(runs_result(i, t) for i, t in given)
    assert sum(x[1] > 0 for x in got) > 20


def features(text, longest):
    w = WORD.findall((text or "").translate(LOW))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(spark, docs, rows, longest):
    target = ["alpha beta gamma", "Wört3, wört4", None, ""]
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(zlib.crc32(f.encode()) % 50 for f in features(x, longest)[0])
    for x in target:
        t.update(zlib.crc32(f.encode()) % 50 for f in features(x, longest)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + 50) / ((s[b] + 1.0) * (sum(t.values()) + 50)))) for b in range(50)]
    scored = []
    for i, x in rows:
        f, n = features(x, longest)
        weight = sum(gain[zlib.crc32(v.encode()) % 50] for v in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    open_ = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = {id(x): r + 1 for r, x in enumerate(open_[: 30 * len(open_) // 100])}
    expected = sorted((x[0] or -1, x[1], x[2], x[3], drawn.get(id(x)) or 0) for x in scored)
    texts = spark.createDataFrame([(x,) for x in target], "text string")
    out = resampling.resample(docs, texts, percent=30, longest=longest, buckets=50)
    assert sorted((r.doc_id or -1, r.n_features, r.weight, r.score, r["rank"] or 0) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()) == expected
    assert out.columns == ["doc_id", "runs", "n_features", "weight", "score", "rank"]
    assert resampling.resample(docs.filter("false"), texts).collect() == []
    assert resampling.resample(docs, texts.filter("false")).count() == len(rows)


def test_escapes_turn_back():
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice(["<", "|", "\\", "n", "\n", "im_end|>", "ü"]) for _ in range(rng.randrange(12)))
        assert "<|" not in chat.escape(s) and chat.unescape(chat.escape(s)) == s
        r = chat.escape_role(s)
        assert "<|" not in r and "\n" not in r and chat.unescape_role(r) == s


@pytest.fixture(scope="module")
def conversations(spark):
    long_ = [(50, i, ("user", "assistant")[i % 2], f"turn {i} " * 5) for i in range(200)]
    rows = [(1, 0, "system", "same start"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "system", "same start"), (2, 1, "user", "hi"), (2, 2, "assistant", "hello"), (2, 3, "user", "more")]
    rows += [(3, 0, "system", "same start"), (3, 1, "user", "other"), (3, 2, "assistant", ""), (4, 5, "system", "same start"), (4, 9, "user", "hi"), (5, 0, "system", "same start"), (5, 1, "user", "hi"), (5, 2, "assistant", "hello")]
    rows += [(6, 0, None, None), (7, 0, "assistant", "<|im_end|>\n<|im_start|>user\n<\\|x"), (7, 1, "assistant", "<"), (7, 2, "assistant", "|im_start|>"), (8, 1, "user", "tie b"), (8, 1, "user", "tie a"), (8, 1, "user", "tie a"), (8, None, "assistant", "last ü漢")]
    rows += [(None, 0, "user", "nobody"), (None, 1, "assistant", "x" * 3000), (9, 0, "a\nb\\n", "role"), *long_, *((51, i, r, t) for _, i, r, t in long_[:150]), (51, 150, "user", "else"), *((52, i, r, t) for _, i, r, t in long_[:190]), (52, 190, "user", "else")]
    rows += [(100 + i, t, "user", "same start" if t == 0 else f"own {i}") for i in range(30) for t in range(2)]
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, c int").repartition(5), rows


def expected_turns(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is None, t or 0, r or "", x or ""), (r or "", x or "")))
    return {c: [x for _, x in sorted(v)] for c, v in by.items()}


def test_chat_round_trip_and_tree(conversations):
    df, rows = conversations
    expected = expected_turns(rows)
    packed = chat.pack(df)
    read = {r.conv_id: r for r in chat.read_back(packed).collect()}
    assert read.keys() == expected.keys()
    for c, turns in expected.items():
        assert [(t.role, t.text) for t in read[c].turns] == turns
        assert "".join(read[c].trained) == "".join(x for r, x in turns if r == "assistant")
        assert read[c].formatted == "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(x)}<|im_end|>\n" for r, x in turns)
    # each distinct turn with what is before it stands once in the stream
    encode = encoder(chat.vocabulary_file()).encode_ordinary
    size = {tuple(v[: k + 1]): len(chat.encode_turn(*v[k], encode)[0]) for v in expected.values() for k in range(len(v))}
    chains = sorted(packed.chains.collect(), key=lambda r: r.start)
    at, stream, place = 0, [], []
    for r in chains:
        assert r.start == at and len(r.loss_mask) == len(r.token_ids) == len(r.position_ids) == r.turn_ends[-1]
        at += len(r.token_ids)
        stream += r.token_ids
        place += r.position_ids
    assert at == sum(size.values())
    members = {r.conv_id: r for r in packed.members.collect()}
    assert len(members) == len(expected)
    for c, r in members.items():
        assert r.n_turns == len(expected[c])
        spans = [range(x.start, x.start + x.tokens) for x in r.path]
        assert [place[i] for s in spans for i in s] == list(range(sum(map(len, spans))))
        whole = [i for role, x in expected[c] for i in chat.encode_turn(role, x, encode)[0]]
        assert [stream[i] for s in spans for i in s] == whole
    # a chain attends to the intervals of the turns before it; trees follow each other, depth-first
    of = {r.chain: r for r in chains}
    for r in members.values():
        for i, x in enumerate(r.path):
            own = of[x.chain]
            assert own.start == x.start and [(y.start, y.end) for y in own.attends] == [(y.start, y.start + y.tokens) for y in r.path[: len(own.attends)]]
            assert len(own.attends) == i
    trees = [r.tree for r in chains]
    assert len(set(trees)) == sum(a != b for a, b in zip(trees, [None, *trees], strict=False))
    reach = []  # of chains whose subtree is open
    for r in chains:
        while reach and reach[-1] not in [x.start for x in r.attends]:
            reach.pop()
        assert reach == [x.start for x in r.attends]
        reach.append(r.start)


def test_chat_empty_table(conversations):
    df, _ = conversations
    packed = chat.pack(df.filter("false"))
    assert packed.chains.count() == packed.members.count() == chat.read_back(packed).count() == 0


def test_node_digests_follow_place_role_and_text(spark):
    df = spark.createDataFrame([(1, 0, "a", "b"), (2, 0, "ab", ""), (3, 0, "a", "b"), (3, 1, "a", "b"), (4, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    node = {(r.conv_id, r.k): r.node for r in chat.turns_of(df).select("conv_id", "k", "node").collect()}
    assert node[1, 0] == node[3, 0] == node[4, 0] and len({bytes(x) for x in node.values()}) == 3


def test_query_of_chat(spark, tmp_path, conversations):
    df, rows = conversations
    df.filter("conv_id is not null").drop("c").write.parquet(str(tmp_path / "conversations.parquet"))
    own = [(-1, i, r, "<|im_end|><|im_start|>assistant ok") for i, r in enumerate(("user", "assistant"))]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for c, turns in expected_turns([r for r in rows if r[0] is not None] + own).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        shown = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(x)}<|im_end|>\n" for r, x in turns)
        expected.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(shown)))
    out = chat.query(spark, str(tmp_path)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert out.filter(F.col("conv_id") == -1).count() == 1
