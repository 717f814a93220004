"""Bootstrap of means and of ranking metrics in one pass over the rows.

A resample gives each row a Poisson weight of mean 1 instead of drawing n row numbers: rows are weighed where they
are, and all draws of a row at once, as a vector. Sums of such vectors are what is shuffled or sent on: one a task
for a mean, three a range of scores for a ranking metric. Neither draws times rows nor a range's weights are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship_package
from .prefix import range_of

#: Distribution of a Poisson weight of mean 1, up to 9: a weight is the number of entries not above a uniform number.
POISSON = [sum(1 / math.factorial(j) for j in range(i + 1)) / math.e for i in range(10)]
#: Rows weighed in one go, which bounds a task's memory by so many vectors.
BLOCK = 2048

Metric = Callable[[DataFrame, str, int, str], list[float | None]]


def weights(keys: list[str], draws: int, seed: str) -> np.ndarray:
    """How often each key's row stands in each resample, by 32 bits of md5 for each: four draws share a digest."""
    rounds = range(-(-draws // 4))
    digests = b"".join(hashlib.md5(f"{seed}:{r}:{key}".encode()).digest() for key in keys for r in rounds)
    u = np.frombuffer(digests, ">u4").reshape(len(keys), -1)[:, :draws] / 4294967296.0
    return np.searchsorted(np.array(POISSON), u, side="right").astype(np.float64)


def mean(value: str) -> Metric:
    """The mean of a column; null where a resample is empty. Rows without a value are left out."""

    def metric(df: DataFrame, key: str, draws: int, seed: str) -> list[float | None]:
        ship_package(df.sparkSession)
        rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("v")).dropna()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(draws), np.zeros(draws)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    w = weights(part.column(0).to_pylist(), draws, seed)
                    n += w.sum(0)
                    total += part.column(1).to_numpy() @ w
            yield pa.RecordBatch.from_arrays([pa.array(range(draws), pa.int32()), pa.array(n), pa.array(total)], names=["draw", "n", "total"])

        sums = rows.mapInArrow(scan, "draw int, n double, total double").groupBy("draw").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        found = {r["draw"]: r["total"] / r["n"] if r["n"] else None for r in sums.collect()}  # a row a draw
        return [found.get(d) for d in range(draws)]

    return metric


class _Range:
    """Sums of one range of scores for all draws: the first and the last score by themselves, what lies between in one.

    ``u`` adds up, for positive rows, the weight of the rows below and half of that of equal ones.
    """

    def __init__(self, draws: int):
        self.first, self.last = None, None  # (score, weight, weight of positives)
        self.k, self.p, self.u = np.zeros(draws), np.zeros(draws), np.zeros(draws)

    def add(self, scores: np.ndarray, labels: np.ndarray, w: np.ndarray) -> None:
        """Rows of rising scores, none below those added before."""
        heads = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
        k, p, s = np.add.reduceat(w, heads), np.add.reduceat(w * labels[:, None], heads), scores[heads]
        if self.last is not None and self.last[0] == s[0]:
            k[0] += self.last[1]
            p[0] += self.last[2]
        elif self.last is not None:
            self._close(*(x[None] for x in self.last[1:]), self.last[0])
        if len(s) > 1:
            self._close(k[:-1], p[:-1], s[0])
        self.last = (s[-1], k[-1], p[-1])

    def _close(self, k: np.ndarray, p: np.ndarray, score: float) -> None:
        if self.first is None:
            self.first, k, p = (score, k[0], p[0]), k[1:], p[1:]
        before = self.k + np.cumsum(k, 0) - k
        self.u += (p * (before + k / 2)).sum(0)
        self.k += k.sum(0)
        self.p += p.sum(0)

    def rows(self, number: int) -> list[tuple]:
        edge = lambda place, x: (number, place, float(x[0]), x[1].tolist(), x[2].tolist(), None)
        out = [edge(0, self.first)] if self.first else []
        return [*out, (number, 1, None, self.k.tolist(), self.p.tolist(), self.u.tolist()), edge(2, self.last)]


def auroc(score: str, label: str, ranges: int | None = None) -> Metric:
    """AUROC of a column of scores for a 0/1 label; null where a resample lacks a class. Rows without either are left out.

    Rows are dealt out by ranges of (score, key), so a score that very many rows have is split too; a range sends on
    the vectors of its first score, of its last and of all between.
    """

    def metric(df: DataFrame, key: str, draws: int, seed: str) -> list[float | None]:
        ship_package(df.sparkSession)
        rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"), F.col(key).cast("string").alias("key")).dropna()
        rows = rows.withColumn("range", range_of(rows, ["s", "key"], ranges)).repartition("range").sortWithinPartitions("range", "s")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, now = None, None

            def done() -> pa.RecordBatch:
                vector = pa.list_(pa.float64())
                kinds = (pa.int32(), pa.int32(), pa.float64(), vector, vector, vector)
                return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*now.rows(number), strict=True), kinds, strict=True)], names=["range", "place", "score", "k", "p", "u"])

            for batch in batches:
                of = batch.column(3).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a and of[a] != number:
                        if now is not None:
                            yield done()
                        number, now = int(of[a]), _Range(draws)
                    for at in range(a, b, BLOCK):
                        part = batch.slice(at, min(BLOCK, b - at))
                        now.add(part.column(0).to_numpy(), part.column(1).to_numpy(), weights(part.column(2).to_pylist(), draws, seed))
            if now is not None:
                yield done()

        parts = rows.mapInArrow(scan, "range int, place int, score double, k array<double>, p array<double>, u array<double>")
        return _combined(parts.collect(), draws)  # three rows a range at most

    return metric


def _combined(parts: list, draws: int) -> list[float | None]:
    k, p, u = np.zeros(draws), np.zeros(draws), np.zeros(draws)
    tie = None

    def close() -> None:
        nonlocal k, p, u
        if tie is not None:
            u += tie[2] * (k + tie[1] / 2)
            k += tie[1]
            p += tie[2]

    for r in sorted(parts, key=lambda r: (r["range"], r["place"])):
        rk, rp = np.array(r["k"]), np.array(r["p"])
        if r["place"] == 1:
            if rk.any():
                close()
                tie = None
                u += np.array(r["u"]) + rp * k
                k += rk
                p += rp
        elif tie is not None and tie[0] == r["score"]:
            tie = (tie[0], tie[1] + rk, tie[2] + rp)
        else:
            close()
            tie = (r["score"], rk, rp)
    close()
    pairs = p * (k - p)
    return [float((a - b * b / 2) / c) if c > 0 else None for a, b, c in zip(u, p, pairs, strict=True)]


def _draws(df: DataFrame, values: list[float | None]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(values)), "draw int, value double")


def bootstrap(df: DataFrame, key: str, draws: int, seed: str, metric: Metric) -> DataFrame:
    """(draw, value) of ``metric``; null where it isn't defined."""
    return _draws(df, metric(df, key, draws, seed))


def paired(df: DataFrame, key: str, draws: int, seed: str, first: Metric, second: Metric) -> DataFrame:
    """(draw, value): the second metric less the first on the same resamples; a metric against itself gives exactly 0.

    Two rankings need two orders, so rows are weighed once for each: weights are cheaper made again than shuffled.
    """
    a = first(df, key, draws, seed)
    b = a if second is first else second(df, key, draws, seed)
    return _draws(df, [None if x is None or y is None else y - x for x, y in zip(a, b, strict=True)])


def interval(draws: DataFrame, value: str = "value") -> DataFrame:
    """One row: 2.5 % and 97.5 % quantiles, mean, and how many draws were asked for and defined."""
    return draws.agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"), F.avg(value).alias("mean"), F.count("*").alias("draws"), F.count(value).alias("valid"))
