"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned online by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty,
then one temperature is fitted on rows left out of training, so that scores are probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fold, table, with_fields, without

#: Hashed feature space, documents a language in the training sample, and the longest text of that sample.
BITS, PER_LANG, MAX_CHARS = 14, 400, 20_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of the lower-cased text with a space at both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * _A
    two = (one[:-1] ^ (c[1:] * _B)) * _C
    three = (two[:-1] ^ (c[2:] * _A)) * _B
    return np.concatenate([one[1:-1] >> np.uint32(32 - bits), two >> np.uint32(32 - bits), three >> np.uint32(32 - bits)])


def term_counts(text: str, bits: int = BITS) -> np.ndarray:
    return np.bincount(grams(text, bits), minlength=1 << bits)


@dataclass
class Ftrl:
    """FTRL-proximal for the softmax: ``z`` and ``n`` for each feature and class, weights on demand."""

    features: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-4

    def __post_init__(self):
        self.z = np.zeros((self.features, self.classes))
        self.n = np.zeros((self.features, self.classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, rows: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(rows)
        p = softmax(x @ w)
        p[y] -= 1.0
        g = x[:, None] * p
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.flatnonzero(counts)
    x = (1.0 + np.log(counts[rows])) * idf[rows]
    norm = np.sqrt(x @ x)
    return rows, x / norm if norm else x


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    bits: int = BITS

    def predict(self, text: str | None) -> tuple[str, float]:
        """``und`` with score 1 where the text is null or has no letter; ``und`` with 0 where nothing was learned."""
        if text is None or not _LETTER.search(text):
            return UNKNOWN, 1.0
        if not self.languages:
            return UNKNOWN, 0.0
        rows, x = tfidf(term_counts(text, self.bits), self.idf)
        p = softmax(x @ self.weights[rows] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(rows: list[tuple[str, str]], idf: np.ndarray, bits: int = BITS, epochs: int = 4) -> LanguageModel:
    """Fit weights on four rows of five of each language and the temperature on the fifth, in the order given."""
    languages = sorted({y for _, y in rows})
    model = Ftrl(1 << bits, max(1, len(languages)))
    data = [(*tfidf(term_counts(t, bits), idf), languages.index(y)) for t, y in rows]
    seen = [0] * len(languages)
    learn, hold = [], []
    for x in data:
        seen[x[2]] += 1
        (learn if seen[x[2]] % 5 else hold).append(x)
    order = np.random.default_rng(7)
    for _ in range(epochs if len(languages) > 1 else 0):
        for i in order.permutation(len(learn)):
            model.learn(*learn[i])
    weights = model.weights()
    logits = np.array([x @ weights[r] for r, x, _ in hold])
    labels = np.array([y for _, _, y in hold], int)
    best, loss = 1.0, np.inf
    for t in np.geomspace(0.05, 5.0, 60) if len(hold) else []:
        p = softmax(logits / t)[np.arange(len(labels)), labels]
        if (now := -np.log(np.maximum(p, 1e-12)).mean() + 1e-4 * abs(np.log(t))) < loss:
            best, loss = float(t), now
    return LanguageModel(languages, idf.astype(np.float32), weights.astype(np.float32), best, bits)


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Of every hashed n-gram, over all rows of ``docs(text)``; what reaches the driver has the size of the feature space."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[np.unique(grams(text or "", bits))] += 1
                n += 1
        rows = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, size).astype(np.int32)), pa.array(np.append(total[rows], n))], names=["f", "n"])

    sums = docs.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return df[:size], int(df[size])


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS, bits: int = BITS) -> LanguageModel:
    """Fit on ``docs(doc_id, text, lang)``: document frequencies over all rows, weights on a bounded sample.

    The sample has for each language the ``per_lang`` distinct rows with the smallest hashes of id and text, of a
    text over ``max_chars`` characters so many from its first letter on: a bound of the classifier's training,
    whatever the size of the table. Every language with a text that has a letter is learned, however its rows
    share ids or texts and however long they are.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.filter("lang is not null and text is not null")
    df, n = document_frequencies(docs, bits)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    usable = docs.filter(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row for each language
    rows = []
    if counts:
        keep = F.lit(False)
        for r in counts:  # a hash threshold that leaves about three times the sample, cut to size before it is collected
            keep |= (F.col("lang") == r["lang"]) & (F.col("h") <= F.lit(int(min(1.0, 3.0 * per_lang / max(1, r["n"])) * (1 << 40))))
        start = F.when(F.length("text") > max_chars, F.regexp_instr("text", F.lit(r"\p{L}"))).otherwise(1)
        part = F.substring(F.col("text"), start, F.lit(max_chars))
        few = usable.filter(keep).select("lang", "h", part.alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))  # of repeated rows one
        place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        few = few.withColumn("place", place).filter(F.col("place") <= per_lang)
        rows = sorted((r["h"], r["text"], r["lang"]) for r in few.collect())  # per_lang texts a language
    return train([(t, y) for _, t, y in rows], idf, bits)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` from its ``text``; columns of these names are replaced.

    A null text and one without a letter (Unicode's L, so no digits, fractions or numerals) get ``und`` and 1. Repeated
    rows and ties get the same result, empty tables an empty one. A very long text is counted whole.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the feature space's size
    rest = without(docs, ("lang_pred", "score"))
    kept = docs.select(*(f"`{c}`" for c in rest))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(scan, with_fields(kept, "lang_pred string, score double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
