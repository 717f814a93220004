"""Substring deduplication over a log-structured index of window fingerprints.

Of all the 50-word windows of a text only anchors are indexed: a window's anchor is the smallest
fingerprint of the 25-word runs in it, so equal windows have equal anchors and one row serves many
neighbouring windows. The index is a list of sorted immutable runs, bucketed tables in the shared folder.
Each new batch of documents becomes a run, is merge-joined with the runs before it, and runs of like size
are compacted when there are several. Windows whose anchors repeat are then verified window by window, by
fingerprints of two independent families (96 bits), and the words that repeated windows cover are removed.

An index that is kept serves later batches: an anchor that one document holds names that document, which is
read again if a later one has the anchor too; of an anchor that several hold, all windows are kept as runs too.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, bounded_batches, release, table
from .words import Words, as_long, run_prints, sliding_min, words_of

WINDOW, RUN = 50, 25
#: Batches in which a whole table is added, runs of one tier that are merged, and how much larger the next tier is.
BATCHES, FAN, TIER = 5, 4, 4
#: Columns of the two kinds of runs and how equal keys of several runs become one row.
KINDS = {
    "anchors": ("fp long, first long, many boolean", ["fp"], lambda: [F.min("first").alias("first"), (F.max("many") | (F.count("*") > 1)).alias("many")]),
    "windows": ("h long, g int, first long", ["h", "g"], lambda: [F.min("first").alias("first")]),
}


class FingerprintIndex:
    """Sorted immutable runs in a folder: anchors (fp, first, many) with the smallest id that has each and whether
    others have it too, and windows (h, g, first) of the anchors that several documents hold.

    ``folder`` must be shared by driver and executors; an index is opened again by its name. Every change
    writes a new list of runs, so a lost run of the driver leaves the last list whole.
    """

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        self.version, self.runs = 0, []
        path = self._path("")
        if self._fs().exists(path):
            lists = [x.getPath().getName() for x in self._fs().listStatus(path) if x.getPath().getName().startswith("list-")]
            if lists:
                last = max(lists)
                self.version = int(last[5:])
                self.runs = [json.loads(r["value"]) for r in spark.read.text(f"{self.folder}/{last}").collect()]

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self) -> None:
        self.version += 1
        rows = self.spark.createDataFrame([(json.dumps(r),) for r in self.runs], "value string")
        rows.coalesce(1).write.text(f"{self.folder}/list-{self.version:09d}")

    def of(self, kind: str) -> list[dict]:
        return [r for r in self.runs if r["kind"] == kind]

    def read(self, run: dict) -> DataFrame:
        if not self.spark.catalog.tableExists(run["name"]):
            columns, keys, _ = KINDS[run["kind"]]
            self.spark.sql(f"CREATE TABLE {run['name']} ({columns}) USING parquet CLUSTERED BY ({keys[0]}) SORTED BY ({keys[0]}) INTO {run['buckets']} BUCKETS LOCATION '{self.folder}/{run['name']}'")
        return self.spark.table(run["name"])

    def _write(self, rows: DataFrame, kind: str) -> dict:
        name, key = f"run_{uuid.uuid4().hex}", KINDS[kind][1][0]
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        run = {"name": name, "kind": kind, "buckets": buckets}
        return run | {"rows": self.read(run).count()}

    def _forget(self, run: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")
        self._fs().delete(self._path(run["name"]), True)

    def add_anchors(self, batch: DataFrame) -> DataFrame:
        """Index ``batch(fp, doc_id)``; (fp, owner) of those that it shares with earlier runs or within itself.

        ``owner`` is the one earlier document that has the anchor, null where several had it or none.
        """
        rows = batch.groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        new = self._write(rows.select("fp", "first", (F.col("first") < F.col("last")).alias("many")), "anchors")
        run = self.read(new)
        found = run.filter("many").select("fp", F.lit(None).cast("long").alias("owner"), F.lit(True).alias("settled"), F.lit(0).alias("old"))
        for old in self.of("anchors"):
            theirs = self.read(old).join(run.select("fp"), "fp", "left_semi")
            found = found.unionByName(theirs.select("fp", F.col("first").alias("owner"), F.col("many").alias("settled"), F.lit(1).alias("old")))
        self.runs.append(new)
        if len(self.of("anchors")) == 1:
            return found.select("fp", "owner")
        own = F.bool_or((F.col("old") == 1) & F.col("settled")) | (F.sum("old") > 1)
        return found.groupBy("fp").agg(F.when(~own, F.min("owner")).alias("owner"))

    def add_windows(self, seen: DataFrame) -> None:
        """Keep ``seen(h, g, doc_id)``."""
        self.runs.append(self._write(seen.groupBy("h", "g").agg(F.min("doc_id").alias("first")), "windows"))

    def known(self, seen: DataFrame) -> DataFrame:
        """(h, g, doc_id) of the windows kept earlier that are in ``seen``, with the smallest id of each run."""
        out, wanted = seen.limit(0), seen.select("h", "g").distinct()
        for run in self.of("windows"):
            out = out.unionByName(self.read(run).join(wanted, ["h", "g"], "left_semi").select("h", "g", F.col("first").alias("doc_id")))
        return out

    def compact(self) -> None:
        """Merge runs of one kind and of like size where there are ``fan`` or more of them."""
        for kind, (_, keys, combined) in KINDS.items():
            while True:
                tiers: dict[int, list[dict]] = {}
                for run in self.of(kind):
                    tiers.setdefault(int(math.log(max(run["rows"], 1), TIER)), []).append(run)
                full = [runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fan]
                if not full:
                    break
                rows = self.read(full[0][0])
                for run in full[0][1:]:
                    rows = rows.unionByName(self.read(run))
                merged = self._write(rows.groupBy(*keys).agg(*combined()), kind)
                self.runs = [r for r in self.runs if r not in full[0]] + [merged]
                self.save()
                for run in full[0]:
                    self._forget(run)

    def close(self) -> None:
        """Delete the runs."""
        for run in self.runs:
            self._forget(run)
        self.runs = []


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, fingerprints, anchors) of every window that lies in one text; starts are word numbers."""
    prints = run_prints(words.prints, WINDOW)
    if not len(prints):
        return np.zeros(0, np.int64), prints, prints
    docs = words.docs()
    starts = np.flatnonzero(docs[: len(prints)] == docs[WINDOW - 1 :])
    anchors = sliding_min(run_prints(words.prints, RUN), WINDOW - RUN + 1)
    return starts, prints[starts], anchors[starts]


def _by_text(words: Words, starts: np.ndarray) -> np.ndarray:
    """``starts`` of text d are at ``edges[d] : edges[d + 1]``."""
    return np.searchsorted(starts, words.first)


def anchors_of(docs: DataFrame) -> DataFrame:
    """(fp, doc_id): the distinct anchors of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1)):
                starts, _, anchors = windows(words)
                edges = _by_text(words, starts)
                lists = [np.unique(as_long(anchors[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                ids = batch.column(0).slice(words.rows.start, len(words.rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "fps"])

    return docs.mapInArrow(scan, "doc_id long, fps array<long>").select(F.explode("fps").alias("fp"), "doc_id")


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row of ``docs(doc_id, text)``.

    A word is removed if a 50-word window covers it whose words also start in a document of a smaller id.
    Null and empty texts, and those under 50 words, lose nothing. Rows of one id are one document: they
    take nothing from each other. Rows with a null id neither lose nor take words. A very long text is read
    whole, in one piece of its own. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    cuts = sorted(set(cuts))
    index, out = FingerprintIndex(spark, scratch.path("index")), None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs if low is None else docs.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter((F.col("doc_id") <= high) | F.col("doc_id").isNull())  # null ids go with the first batch
        rows = add_batch(index, part, docs.filter(F.col("doc_id") <= low) if low is not None else docs.limit(0), with_text)
        out = rows if out is None else out.unionByName(rows)
    index.close()
    return out


def add_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame, with_text: bool = False) -> DataFrame:
    """As ``remove_repeats``, of the rows of ``batch``, against all documents that ``index`` has met and the batch itself.

    ``history(doc_id, text)`` has the documents of earlier batches; only those that alone hold an anchor of the
    batch are read again. Ids of a batch are above those of earlier ones, else what is left to an earlier
    document stays there. A batch must be added once; afterwards the index may be opened by another session.
    """
    spark = batch.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "batch")
    batch = batch.selectExpr("cast(doc_id as long) doc_id", "text")
    hits = scratch.write(index.add_anchors(anchors_of(batch.filter("doc_id is not null"))), "hits")
    bits = spark.sparkContext.broadcast(bloom.build(hits.select("fp").distinct(), "fp"))
    first_look = scratch.write(_first_look(batch, bits, with_text), "suspects")
    owners = hits.filter("owner is not null").select(F.xxhash64("owner").alias("p")).distinct()
    only = spark.sparkContext.broadcast(bloom.build(owners, "p"))
    history = history.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("p"))
    again = _first_look(history, bits, False, only)  # owners, and few others that the filter lets through, do no harm
    seen = scratch.write(_windows_of(first_look).unionByName(_windows_of(again)), "seen")
    earlier = scratch.write(index.known(seen), "known")
    gone = _gone(seen.unionByName(earlier), scratch)
    out = scratch.write(_removed(first_look, gone, with_text), "removed")
    index.add_windows(seen)
    index.save()
    index.compact()
    bits.destroy()
    only.destroy()
    release()
    scratch.drop("hits", "suspects", "seen", "known", "several")
    return out


def _first_look(docs: DataFrame, shared, with_text: bool, only=None) -> DataFrame:
    """Of every row its number of words and, if it has windows with anchors among the bits that are ``shared``, its text and their fingerprints.

    With ``only``, bits too, rows whose fingerprint in a third column isn't among them are left out.
    """

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(bloom.contains(only.value, batch.column(2).to_numpy().view(np.uint64))))
            texts = batch.column(1)
            for words in words_of(texts):
                starts, prints, anchors = windows(words)
                hit = bloom.contains(shared.value, anchors)
                edges, rows = _by_text(words, starts), []
                if hit.any():
                    second = (run_prints(words.second(), WINDOW, 1)[starts] >> np.uint64(33)).astype(np.int32)
                for d, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    text = texts[words.rows[d]].as_py()
                    found, at = np.unique(as_long(prints[a:b][hit[a:b]]), return_index=True)
                    if len(found) and batch.column(0)[words.rows[d]].is_valid:
                        rows.append((int(words.counts[d]), None, text, found, second[a:b][hit[a:b]][at]))
                    else:
                        rows.append((int(words.counts[d]), _digest((text or "").encode("utf-8", "surrogatepass").split()), text if with_text else None, None, None))
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.rows.start, len(rows)), *(pa.array(list(c), t) for c, t in columns)], names=["doc_id", "n_words", "kept_sha256", "text", "h", "g"])

    return docs.mapInArrow(suspect, "doc_id long, n_words long, kept_sha256 string, text string, h array<long>, g array<int>")


def _windows_of(first_look: DataFrame) -> DataFrame:
    """(h, g, doc_id) of the suspect windows, each once for a document."""
    return first_look.filter("h is not null").select("doc_id", F.explode(F.arrays_zip("h", "g")).alias("w")).select("w.h", "w.g", "doc_id")


def _gone(seen: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, gone): fingerprints of each document's windows that also start in a document of a smaller id.

    Windows are equal where both fingerprints are; within a document the first tells them apart. Shared windows are
    a written table, so that the rows of one that very many documents have can be split over tasks.
    """
    several = seen.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "g", "first")
    several = scratch.write(several, "several")
    gone = seen.join(several.hint("merge"), ["h", "g"]).filter("doc_id > first")
    return gone.groupBy("doc_id").agg(F.collect_set("h").alias("gone"))


def _removed(first_look: DataFrame, gone: DataFrame, with_text: bool) -> DataFrame:
    """The result rows: open texts without the words that their gone windows cover, others as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            for words in words_of(texts):
                starts, prints, _ = windows(words)
                edges, rows = _by_text(words, starts), []
                for d, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    own = texts[words.rows[d]].as_py().encode("utf-8", "surrogatepass").split()
                    drop = lists[words.rows[d]]
                    depth = np.zeros(len(own) + 1, np.int64)
                    if drop.is_valid:
                        at = starts[a:b][np.isin(as_long(prints[a:b]), drop.values.to_numpy())] - words.first[d]
                        depth[at] += 1
                        depth[at + WINDOW] -= 1
                    covered = np.cumsum(depth)[:-1] > 0
                    kept = [w for w, c in zip(own, covered.tolist(), strict=True) if not c]
                    rows.append((len(own), len(own) - len(kept), _digest(kept), b" ".join(kept).decode("utf-8", "surrogatepass") if with_text else None))
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.rows.start, len(rows)), *(pa.array(list(c), t) for c, t in columns)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = first_look.filter("h is not null").select("doc_id", "text").join(gone, "doc_id", "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    clean = first_look.filter("h is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.col("text").alias("kept_text"))
    out = done.unionByName(clean)
    return out if with_text else out.drop("kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i FROM v JOIN f USING (h) WHERE doc_id > first), range(50) t(j)),
n AS (SELECT r, count(*) AS n_removed FROM c GROUP BY r),
k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
