"""Detection of runs: stretches of words that repeat with a period, by the divide and conquer of Main and Lorentz.

Words are interned as numbers. A text is halved again and again; a run that crosses a midpoint holds at least
half of its length on one side of it, and there the Z-function of that half shows its period: the half's words
match those a period away for at least a period. A second Z-function, of the reversed text, says how far the run
goes on beyond the midpoint. Runs that a neighbouring word would extend are parts of one found at a wider halving
and are left out; of equal intervals the smallest period stays.

All texts of an Arrow batch are halved together, a level at a time, by numpy: only halves whose first words match
again further on get Z-functions, which take time linear in the half. So texts without repetitions cost one
comparison a word and level, periodic ones n log n.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, with_fields, without

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of a half that are compared before a Z-function is made.
PROBE = 8
RUN = "start long, length long, period long"
BLANKS = r"[\x20\x09-\x0D]+"


def z_function(s: list[int]) -> list[int]:
    """How many items from each place on equal the first ones; 0 at place 0."""
    n, z, left, right = len(s), [0] * len(s), 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[i + k] == s[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(near: list[int], far: list[int], periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of repetitions with a period that ``near`` shows from its first item on: how far they reach into ``near``, and back into ``far``.

    ``far`` is read away from the midpoint too. Reaches count from the midpoint; a repetition of period q
    matches near[i] with near[i + q], and far[i] with what stands q items towards ``near``.
    """
    ahead = np.array(z_function(near))[periods] + periods
    back = near[::-1] + far  # the whole stretch, from the far end of ``near`` backwards
    z = np.array(z_function([*far, -1, *back]))
    return ahead, z[len(far) + 1 + len(near) - periods]


def _probed(ids: np.ndarray, mids: np.ndarray, periods: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """Which pairs of midpoint and period may belong to a run whose larger part lies on the side that ``step`` goes to."""
    need = np.maximum(periods, LEAST_WORDS // 2 - periods)  # words that must match those a period on
    keep = periods + need <= room
    mids, periods, need, chosen = mids[keep], periods[keep], need[keep], np.flatnonzero(keep)
    at = mids if step > 0 else mids - 1
    for i in range(1, PROBE):
        same = need <= i
        inner = np.flatnonzero(~same)
        same[inner] = ids[at[inner] + step * i] == ids[at[inner] + step * (i + periods[inner])]
        at, periods, need, chosen = at[same], periods[same], need[same], chosen[same]
    return chosen


def runs(ids: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run, by start and period.

    ``ids`` are non-negative numbers of the words of some texts in a row, text d has ``first[d] : first[d + 1]``;
    no run crosses texts.
    """
    n = len(ids)
    begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    padded = np.append(ids, np.full(-n % (1 << max(3, (n - 1).bit_length())) if n else 0, -1, ids.dtype))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    half = 4
    while half < n:
        blocks = padded.reshape(-1, 2 * half)
        reach = half // 2
        for step in (1, -1):
            side = blocks[:, half:] if step > 0 else blocks[:, half - 1 :: -1]
            block, shift = np.nonzero(side[:, 1 : reach + 1] == side[:, :1])
            mids, periods = block * (2 * half) + half, shift + 1
            inside = mids < n
            mids, periods = mids[inside], periods[inside]
            low, high = begin[np.maximum(mids - (step < 0), 0)], end[mids - (step < 0)]
            room = np.minimum(half, high - mids if step > 0 else mids - low)
            chosen = _probed(padded, mids, periods, room, step)
            mids, periods, low, high = mids[chosen], periods[chosen], low[chosen], high[chosen]
            cuts = np.flatnonzero(np.diff(mids)) + 1
            for of in np.split(np.arange(len(mids)), cuts) if len(mids) else []:
                mid, q = int(mids[of[0]]), periods[of]
                left = ids[max(mid - half, int(low[of[0]])) : mid][::-1].tolist()
                right = ids[mid : min(mid + half, int(high[of[0]]))].tolist()
                ahead, back = _crossing(right, left, q) if step > 0 else _crossing(left, right, q)
                s, e = (mid - back, mid + ahead) if step > 0 else (mid - ahead, mid + back)
                found.append((s, e, q))
        half *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = (np.concatenate([x[i] for x in found]).astype(np.int64) for i in range(3))
    keep = e - s >= np.maximum(least_words, least_periods * q)
    s, e, q = s[keep], e[keep], q[keep]
    longer = ((s > begin[s]) & (ids[s - 1] == ids[s - 1 + q])) | ((e < end[s]) & (ids[np.minimum(e, n - 1)] == ids[e - q]))
    s, e, q = s[~longer], e[~longer], q[~longer]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    head = np.ones(len(s), bool)
    head[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[head], e[head], q[head]
    order = np.lexsort((q, s))
    return s[order], (e - s)[order], q[order]


def _scan(texts: list[bytes | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs, and the words that no run repeats, joined by a space."""
    numbers: dict[bytes, int] = {}
    words = [(t or b"").split() for t in texts]  # bytes split at exactly the six blanks
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(words)), np.int64)
    first = np.cumsum([0, *map(len, words)])
    start, length, period = runs(ids, first)
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    dropped = np.cumsum(dropped)[:-1] > 0
    of = np.searchsorted(start, first)
    collapsed = []
    for d, own in enumerate(words):
        if of[d] < of[d + 1]:
            gone = dropped[first[d] : first[d + 1]].tolist()
            own = [w for w, x in zip(own, gone, strict=True) if not x]
        collapsed.append(b" ".join(own))
    base = np.repeat(first[:-1], np.diff(of))
    items = pa.StructArray.from_arrays([pa.array(start - base), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    return pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), items), pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``runs array<struct<start, length, period>>``, ``collapsed``.

    Words are what stands between blanks (space and \\t to \\r), numbered from 0. A run is a stretch of at least 6
    words and 4 smallest periods that no neighbouring word extends; ``runs`` has all of them, by start, then period.
    ``collapsed`` is the text without the words that some run holds after its first period, joined by one space.
    Columns of these names are replaced. A null or blank text has no words, no runs and an empty ``collapsed``;
    repeated rows get equal results, an empty table gives an empty one. Texts are read whole, whatever their length.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(*(f"`{c}`" for c in without(docs, ("n_words", "runs", "collapsed"))))
    if text not in kept.columns:
        raise ValueError(f"no column {text}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = _scan(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "n_words", "runs", "collapsed"])

    return kept.mapInArrow(scan, with_fields(kept, f"n_words long, runs array<struct<{RUN.replace(' long', ': long')}>>, collapsed string"))


def highest(found: Column) -> Column:
    """The run of the greatest exact length / period; of ties the first by start, then period. Null if there is none."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(found, F.lit(None).cast(f"struct<{RUN.replace(' long', ': long')}>"), lambda a, r: F.when(better(a, r), r).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the query's own repetitions: every tenth document by hash repeats its tail from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    split = docs.withColumns({"_g": F.floor(h / 10), "_words": F.when(h % 10 == 0, words)})
    n = F.size("_words")
    split = split.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    split = split.withColumn("_p", F.lit(1) + F.expr("(size(_words) - _a) div (3 + _g % 8)"))
    tail = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return split.select("doc_id", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("_top", highest(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_top.start",
        "_top.length",
        "_top.period",
        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
