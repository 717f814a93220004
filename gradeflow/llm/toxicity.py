"""Toxicity: a bidirectional gated recurrent network with attention pooling over characters and words.

A word's vector joins an embedding with what a small bidirectional GRU and attention make of its
characters. A second bidirectional GRU with attention reads windows of words; windows overlap by half
and cover the whole text. A word longer than the character reader takes is read in overlapping pieces that
cover it, each a word of its own to the window. A text's score is that of its most toxic window. Everything is numpy: forward
and backward passes, and Adam.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fold, table
from .words import CHUNK, NON_WORD, Words, byte_prints, words_of

#: Window and stride in words; bytes of a word, or of a piece of a longer one, that are read.
WINDOW, STRIDE, CHARS = 24, 12, 16
VOCABULARY, DIM, HIDDEN, CHAR_DIM, CHAR_HIDDEN = 1 << 13, 8, 8, 6, 6
#: Texts of the sample that must have a word for it to get an embedding of its own; all others share one.
LEAST_TEXTS = 4
#: The training sample: rows of each label, and the longest text.
PER_LABEL, MAX_CHARS = 1_500, 20_000
THRESHOLD = 0.7
#: Texts by which the log-odds of a word are drawn to zero; windows read at least in a round of training.
PRIOR, LEAST_WINDOWS = 8, 4_000
#: Words of which a worker remembers the vectors.
REMEMBERED = 200_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Gru:
    """One direction of a GRU over padded sequences, with its backward pass."""

    def __init__(self, p: dict, name: str, reverse: bool):
        self.p, self.name, self.reverse = p, name, reverse

    def run(self, xw: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        """``xw``: inputs already multiplied by W, (n, t, 3h); returns states (n, t, h)."""
        u, n, t = self.p[self.name + "U"], xw.shape[0], xw.shape[1]
        h = u.shape[0]
        state, out, self.steps = np.zeros((n, h), np.float32), np.empty((n, t, h), np.float32), []
        for i in range(t - 1, -1, -1) if self.reverse else range(t):
            x = xw[:, i]
            zr = sigmoid(x[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            m = mask[:, i, None]
            if keep:
                self.steps.append((i, state, z, r, c, m))
            state = state + m * z * (c - state)
            out[:, i] = state
        return out

    def back(self, d_out: np.ndarray, g: dict) -> np.ndarray:
        u = self.p[self.name + "U"]
        h = u.shape[0]
        d_xw, d_u = np.zeros((*d_out.shape[:2], 3 * h), np.float32), np.zeros_like(u)
        d = np.zeros((d_out.shape[0], h), np.float32)
        for i, state, z, r, c, m in reversed(self.steps):
            d = d + d_out[:, i]
            dm = d * m
            dc = dm * z * (1 - c * c)
            dz = dm * (c - state) * z * (1 - z)
            d_rs = dc @ u[:, 2 * h :].T
            dr = d_rs * state * r * (1 - r)
            d_xw[:, i] = np.concatenate([dz, dr, dc], 1)
            d_u[:, : 2 * h] += state.T @ d_xw[:, i, : 2 * h]
            d_u[:, 2 * h :] += (r * state).T @ dc
            d = d - dm * z + d_rs * r + d_xw[:, i, : 2 * h] @ u[:, : 2 * h].T
        g[self.name + "U"] = d_u
        return d_xw


class Reader:
    """Bidirectional GRU and attention pooling: (n, t, d) inputs to (n, 2h)."""

    def __init__(self, p: dict, name: str):
        self.p, self.name = p, name
        self.ahead, self.behind = Gru(p, name + "f", False), Gru(p, name + "b", True)

    @staticmethod
    def make(rng, name: str, d: int, h: int) -> dict:
        p = {}
        for way in "fb":
            p[f"{name}{way}W"] = rng.normal(0, d**-0.5, (d, 3 * h))
            p[f"{name}{way}U"] = rng.normal(0, h**-0.5, (h, 3 * h))
            p[f"{name}{way}B"] = np.zeros(3 * h)
        p[name + "A"] = rng.normal(0, 0.3, 2 * h)
        return {k: v.astype(np.float32) for k, v in p.items()}

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs of both directions, side by side: (..., 6h)."""
        return np.concatenate([x @ self.p[f"{self.name}{w}W"] + self.p[f"{self.name}{w}B"] for w in "fb"], -1)

    def pool(self, xw: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        half = xw.shape[-1] // 2
        h = np.concatenate([self.ahead.run(xw[..., :half], mask, keep), self.behind.run(xw[..., half:], mask, keep)], -1)
        e = np.where(mask > 0, h @ self.p[self.name + "A"], -1e9)
        a = np.exp(e - e.max(1, keepdims=True)) * mask
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        if keep:
            self.h, self.a = h, a
        return np.einsum("nt,nth->nh", a, h)

    def back(self, d_pooled: np.ndarray, x: np.ndarray, g: dict) -> np.ndarray:
        """Gradients of the parameters into ``g``; returns that of ``x``."""
        h, a, v = self.h, self.a, self.p[self.name + "A"]
        d_a = np.einsum("nh,nth->nt", d_pooled, h)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g[self.name + "A"] = np.einsum("nt,nth->h", d_e, h)
        d_h = a[..., None] * d_pooled[:, None] + d_e[..., None] * v
        half, d_x = h.shape[-1] // 2, np.zeros_like(x)
        for gru, way, d in ((self.ahead, "f", d_h[..., :half]), (self.behind, "b", d_h[..., half:])):
            d_xw = gru.back(d, g)
            w = f"{self.name}{way}"
            g[w + "W"] = np.einsum("ntd,nth->dh", x, d_xw, optimize=True)
            g[w + "B"] = d_xw.sum((0, 1))
            d_x += d_xw @ self.p[w + "W"].T
        return d_x


class Network:
    """Parameters by name, and what is computed from them."""

    def __init__(self, p: dict | None = None, seed: int = 11, vocabulary: np.ndarray | None = None):
        if p is None:
            vocabulary = np.zeros(0, np.uint64) if vocabulary is None else vocabulary
            rng = np.random.default_rng(seed)
            p = {"words": rng.normal(0, 0.05, (len(vocabulary) + 1, DIM)).astype(np.float32), "chars": rng.normal(0, 0.3, (256, CHAR_DIM)).astype(np.float32)}
            p |= Reader.make(rng, "c", CHAR_DIM, CHAR_HIDDEN) | Reader.make(rng, "w", DIM + 2 * CHAR_HIDDEN, HIDDEN)
            p |= {"out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), "bias": np.full(1, -2.0, np.float32)}
            p["vocabulary"] = vocabulary
        self.p, self.vocabulary = p, p["vocabulary"]
        self.chars, self.words = Reader(p, "c"), Reader(p, "w")

    def rows_of(self, prints: np.ndarray) -> np.ndarray:
        """Rows of the embedding: 0 for words without one of their own."""
        at = np.searchsorted(self.vocabulary, prints)
        hit = at < len(self.vocabulary)
        hit[hit] = self.vocabulary[at[hit]] == prints[hit]
        return np.where(hit, at + 1, 0)

    def word_vectors(self, prints: np.ndarray, letters: np.ndarray, keep: bool = False) -> np.ndarray:
        mask = (letters > 0).astype(np.float32)
        x = self.p["chars"][letters]
        pooled = self.chars.pool(self.chars.project(x), mask, keep)
        rows = self.rows_of(prints)
        if keep:
            self.kept = rows, letters, x
        return np.concatenate([self.p["words"][rows], pooled], 1)

    def logits(self, projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of windows of word numbers (-1: none), given the words' projections."""
        mask = (ids >= 0).astype(np.float32)
        return self.words.pool(projected[np.maximum(ids, 0)], mask) @ self.p["out"] + self.p["bias"]

    def step(self, prints: np.ndarray, letters: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted cross-entropy of some windows, and their probabilities."""
        g: dict = {}
        vectors = self.word_vectors(prints, letters, keep=True)
        mask = (ids >= 0).astype(np.float32)
        x = vectors[np.maximum(ids, 0)]
        pooled = self.words.pool(self.words.project(x), mask, keep=True)
        p = sigmoid(pooled @ self.p["out"] + self.p["bias"])
        d = ((p - y) * weight / max(1.0, float(weight.sum()))).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d, d.sum(keepdims=True)
        d_x = self.words.back(d[:, None] * self.p["out"], x, g) * mask[..., None]
        d_v = np.zeros_like(vectors)
        np.add.at(d_v, np.maximum(ids, 0).ravel(), d_x.reshape(-1, d_x.shape[-1]))
        rows, letters, cx = self.kept
        g["words"] = np.zeros_like(self.p["words"])
        np.add.at(g["words"], rows, d_v[:, :DIM])
        d_cx = self.chars.back(d_v[:, DIM:], cx, g) * (letters > 0)[..., None]
        g["chars"] = by_letter(d_cx, letters)
        return g, p


def by_letter(d: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Sums of (n, t, d) gradients by letter: (256, d)."""
    return np.stack([np.bincount(letters.ravel(), d[..., k].ravel(), 256) for k in range(d.shape[-1])], 1).astype(np.float32)


def _breaks() -> str:
    """A class of the blanks and punctuation outside ASCII, for Arrow's regular expressions."""
    found = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] in "ZP" or c in (0x85, 0x200B, 0xFEFF)]
    heads = [c for c, before in zip(found, [0, *found[:-1]], strict=True) if c != before + 1]
    tails = [c for c, after in zip(found, [*found[1:], 0], strict=True) if c != after - 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(heads, tails, strict=True)) + "]"


BREAKS = _breaks()


def inputs_of(column: pa.Array, chunk: int = CHUNK) -> Iterator[Words]:
    """Words of every text, which also end at blanks and punctuation outside ASCII; long ones in pieces."""
    spaced = pc.replace_substring_regex(column, BREAKS, " ")
    yield from map(in_pieces, words_of(spaced, lower=True, ends=NON_WORD, chunk=chunk))


def in_pieces(words: Words) -> Words:
    """Words of over CHARS bytes as pieces of CHARS bytes, of which each begins in the middle of that before; the last ends with the word."""
    spare = np.maximum(words.ends - words.starts - CHARS, 0)
    if not spare.any():
        return words
    step = CHARS // 2
    n = 1 - (-spare // step)
    upto = np.concatenate([[0], np.cumsum(n)])
    word = np.repeat(np.arange(len(n)), n)
    starts = words.starts[word] + np.minimum((np.arange(len(word)) - upto[word]) * step, spare[word])
    ends = np.minimum(starts + CHARS, words.ends[word])
    return Words(words.data, starts, ends, byte_prints(words.data, starts, ends), upto[words.first], words.rows)


def letters_of(words: Words, rows: np.ndarray) -> np.ndarray:
    """The bytes of some words, (n, CHARS), 0 where there are fewer."""
    starts, sizes = words.starts[rows], words.ends[rows] - words.starts[rows]
    at = np.arange(CHARS)
    return np.where(at < sizes[:, None], words.data[np.minimum(starts[:, None] + at, len(words.data) - 1)], 0)


def windows_of(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows over every text's words: word numbers (-1: none), and the text of each window."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    docs = np.repeat(np.arange(len(counts)), n)
    begin = (np.arange(len(docs)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    ids = (first[docs] + begin)[:, None] + np.arange(WINDOW)
    return np.where(ids < (first[docs] + counts[docs])[:, None], ids, -1), docs


class Scorer:
    """Scores texts, remembering the projections of words it has met."""

    def __init__(self, p: dict):
        self.net = Network(p)
        self.known = np.zeros(0, np.uint64)
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def project(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Projections of the distinct words, and each word's row of them."""
        prints, index, rows = np.unique(words.prints, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, prints)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == prints[hit]
        out = np.empty((len(prints), 6 * HIDDEN), np.float32)
        out[hit] = self.table[at[hit]]
        new = np.flatnonzero(~hit)
        for a in range(0, len(new), 8192):
            part = new[a : a + 8192]
            out[part] = self.net.words.project(self.net.word_vectors(prints[part], letters_of(words, index[part])))
        if len(new):
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.table = self.known[:0], self.table[:0]
            order = np.argsort(both := np.concatenate([self.known, prints[new]]))
            self.known, self.table = both[order], np.concatenate([self.table, out[new]])[order]
        return out, rows

    def score(self, column: pa.Array) -> np.ndarray:
        """The highest window probability of each text; 0 without words."""
        best = np.zeros(len(column))
        for words in inputs_of(column):
            if not len(words.prints):
                continue
            projected, rows = self.project(words)
            ids, docs = windows_of(words.counts, words.first[:-1])
            flat = np.where(ids >= 0, rows[np.maximum(ids, 0)], -1)
            for a in range(0, len(ids), 4096):
                p = sigmoid(self.net.logits(projected, flat[a : a + 4096]))
                np.maximum.at(best, words.rows.start + docs[a : a + 4096], p)
        return best


class Adam:
    """Adam's moments of some parameters, which are changed in place."""

    def __init__(self, p: dict, rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def word_lesson(net: Network, prints: np.ndarray, letters: np.ndarray, toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int], rng, steps: int = 2_000, batch: int = 512) -> np.ndarray:
    """Teach the character reader which words favour toxic texts; returns the evidence of each word, 0 for most.

    ``toxic`` and ``clean``: numbers of texts of each label with the word. Words drawn by these numbers, as many
    from each, make the reader's logit the log-odds of a spelling, which new words share. The first place of a
    word's embedding begins with its own log-odds, drawn to zero by ``PRIOR`` texts.
    """
    share = texts[0] / sum(texts)
    odds = np.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - np.log(share / (1 - share))
    rows = net.rows_of(prints)
    net.p["words"][rows[rows > 0], 0] = odds[rows > 0] / 2
    head = {"hint": rng.normal(0, 0.3, 2 * CHAR_HIDDEN).astype(np.float32), "level": np.zeros(1, np.float32)}
    taught = {k: x for k, x in net.p.items() if k == "chars" or (k[0] == "c" and k[1:2] in "fbA")} | head
    adam = Adam(taught)
    sums = np.cumsum(toxic), np.cumsum(clean)
    for _ in range(steps):
        ones, zeros = (np.searchsorted(c, rng.integers(0, c[-1], batch), side="right") for c in sums)
        part, inverse = np.unique(np.concatenate([ones, zeros]), return_inverse=True)
        drawn, hits = np.bincount(inverse), np.bincount(inverse[:batch], minlength=len(part))
        g: dict = {}
        here = letters[part]
        mask = (here > 0).astype(np.float32)
        x = net.p["chars"][here]
        pooled = net.chars.pool(net.chars.project(net.p["chars"])[here], mask, keep=True)
        d = ((sigmoid(pooled @ head["hint"] + head["level"]) * drawn - hits) / (2 * batch)).astype(np.float32)
        g["hint"], g["level"] = pooled.T @ d, d.sum(keepdims=True)
        g["chars"] = by_letter(net.chars.back(d[:, None] * head["hint"], x, g) * mask[..., None], here)
        adam.step(g)
    read = np.concatenate([net.word_vectors(prints[a : a + 8192], letters[a : a + 8192])[:, DIM:] @ head["hint"] + head["level"] for a in range(0, len(prints), 8192)])
    return np.maximum(0, read - 1) + np.maximum(0, np.where(rows > 0, odds, 0) - 1)


def train(texts: list[str], labels: list[int], rounds: int = 6, batch: int = 128, seed: int = 5) -> dict:
    """Texts teach by their most toxic window: at first that with the most evidence of words, then that of the network.

    A toxic text counts only if its most toxic window stands out from those of clean texts; clean texts
    teach by their most toxic windows, the highest of all and some others.
    """
    net = Network()
    if not texts or len(set(labels)) < 2:
        net.p["out"][:] = 0  # nothing to tell apart: every text scores near zero
        net.p["bias"][:] = -9
        return net.p
    (words,) = inputs_of(pa.array(texts, pa.large_string()), chunk=1 << 60)
    _, index, rows = np.unique(words.prints, return_index=True, return_inverse=True)
    ids, docs = windows_of(words.counts, words.first[:-1])
    ids = np.where(ids >= 0, rows[np.maximum(ids, 0)], -1)
    label = np.array(labels, np.int64)
    y = label[docs].astype(np.float32)
    if not len(ids) or y.min() == y.max():
        return train([], [])  # the texts of a label have no words
    prints, letters = words.prints[index], letters_of(words, index)
    pairs = np.unique(rows.astype(np.int64) * len(texts) + words.docs())
    spread = [np.bincount(pairs[label[pairs % len(texts)] == t] // len(texts), minlength=len(prints)) for t in (1, 0)]
    common = np.argsort(-(spread[0] + spread[1]), kind="stable")[:VOCABULARY]
    net = Network(vocabulary=np.sort(prints[common[(spread[0] + spread[1])[common] >= LEAST_TEXTS]]))
    rng = np.random.default_rng(seed)
    evidence = word_lesson(net, prints, letters, *spread, (int(label.sum()), int((1 - label).sum())), rng)
    logit = np.where(ids >= 0, evidence[np.maximum(ids, 0)], 0).sum(1)
    adam = Adam({k: x for k, x in net.p.items() if k != "vocabulary"})
    negatives = np.flatnonzero(y == 0)
    for turn in range(rounds):
        if turn:
            projected = np.concatenate([net.words.project(net.word_vectors(prints[a : a + 8192], letters[a : a + 8192])) for a in range(0, len(prints), 8192)])
            logit = np.concatenate([net.logits(projected, ids[a : a + 4096]) for a in range(0, len(ids), 4096)])
        order = np.lexsort((-logit, docs))
        top = order[np.unique(docs[order], return_index=True)[1]]  # the most toxic window of each text
        level = np.quantile(logit[top[y[top] == 0]], 0.95)
        explained = top[(y[top] == 1) & (logit[top] > level)]  # labels that no window explains are left out
        hard = negatives[np.argsort(-logit[negatives], kind="stable")[: len(top)]]
        easy = rng.choice(negatives, min(len(negatives), 2 * len(top)), replace=False)
        use = np.concatenate([np.repeat(explained, 4), top[y[top] == 0], hard, easy])
        while len(use) < LEAST_WINDOWS:  # small samples are read more than once in a round
            use = np.concatenate([use, use])
        rng.shuffle(use)
        for a in range(0, len(use), batch):
            part = use[a : a + batch]
            here, inverse = np.unique(ids[part], return_inverse=True)
            inverse = inverse.reshape(ids[part].shape)
            if here[0] < 0:
                here, inverse = here[1:], inverse - 1
            g, _ = net.step(prints[here], letters[here], inverse, y[part], np.ones(len(part), np.float32))
            adam.step(g)
    return net.p


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> dict:
    """Train on a bounded sample: for each label the ``per_label`` rows whose ids have the smallest hashes.

    Rows whose text is null, empty or longer than ``max_chars`` can't be in the sample, so others take their places;
    an id with both labels counts as toxic.
    """
    wanted = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    wanted = wanted.join(docs.filter(F.length("text").between(1, max_chars)).select("doc_id"), "doc_id", "left_semi")
    few = [r for y in (0, 1) for r in wanted.filter(F.col("toxic") == y).orderBy("h", "doc_id").limit(per_label).collect()]
    if not few:
        return train([], [])
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"], r["h"]) for r in few], "doc_id long, y int, h long")
    rows = docs.filter(F.length("text").between(1, max_chars)).join(F.broadcast(ids), "doc_id").select("h", "doc_id", "text", "y").collect()  # of 2 * per_label ids
    rows = sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: (r["h"], r["doc_id"]))
    return train([r["text"] for r in rows], [r["y"] for r in rows])


def score_toxicity(docs: DataFrame, parameters: dict, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score every whole text: doc_id, score, predicted.

    A null or empty text, and one without words, scores 0; a null id stays null. Repeated rows get the same score, an empty
    table gives an empty result; no other column is read. A very long text is read whole, window by window.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parameters)  # of fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            score = np.clip(scorer.score(batch.column(1)), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr(f"cast({id_column} as long) doc_id", f"{text_column} text").mapInArrow(scan, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = fold("doc_id", 3) != 1
    parameters = fit(docs.filter(learn), table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(learn))
    return score_toxicity(docs, parameters).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", "predicted")


