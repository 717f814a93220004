"""Benchmark decontamination: MinHash containment search over items partitioned by size, DataFrame functions only.

Items are partitioned by the power of two below their number of shingles. A partition has one sketch size m,
which follows its largest possible size u and the threshold t: m = u - ceil(t * u) + 1. An item's sketch is its m
smallest shingle hashes, or all it has. A document with a share t of an item of n shingles lacks at most
n - ceil(t * n) of them, so of a sketch of k hashes at least k - (n - ceil(t * n)) are among the document's,
one or more: looking the sketches up among all the shingle hashes of a document misses nothing, and fewer
hits make no candidate. Partitions are looked up in passes whose sketches are small enough to be broadcast.
Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table

SHINGLE, THRESHOLD = 5, 0.8
#: Sketch rows of one pass, which are broadcast (some 50 bytes each), and bytes of items' shingles up to which those are.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWERED), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def hashes(array: Column, n: int) -> Column:
    """One hash for each run of ``n`` words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(array) - n), lambda i: F.xxhash64(*(F.get(array, i + j) for j in range(n))))
    return F.when(F.size(array) >= n, runs).otherwise(F.array().cast("array<long>"))


def shingles(array: Column, n: int) -> Column:
    """The runs of ``n`` words as texts."""
    runs = F.transform(F.sequence(F.lit(0), F.size(array) - n), lambda i: F.concat_ws(" ", *(F.get(array, i + j) for j in range(n))))
    return F.when(F.size(array) >= n, runs).otherwise(F.array().cast("array<string>"))


def item_shingles(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, width, total, shingle) of every item with a word; items of fewer than ``n`` words are one shingle."""
    w = benchmark.select("item_id", words().alias("w")).filter("size(w) > 0 and item_id is not null")
    width = F.least(F.size("w"), F.lit(n))
    by_width = F.coalesce(*(F.when(width == k, F.array_distinct(shingles(F.col("w"), k))) for k in range(n, 0, -1)))
    return w.select("item_id", width.alias("width"), by_width.alias("s")).withColumn("total", F.size("s")).select("item_id", "width", "total", F.explode("s").alias("shingle"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(size_class, item_id, width, least, h): each item's smallest hashes, as many as its partition's sketch size, and how many a document must hold."""
    hashed = items.withColumn("h", F.coalesce(*(F.when(F.col("width") == k, F.xxhash64(*(F.get(F.split("shingle", " "), F.lit(j)) for j in range(k)))) for k in range(SHINGLE, 0, -1))))
    by_item = hashed.groupBy("item_id", "width", "total").agg(F.array_sort(F.collect_set("h")).alias("hs"))  # an item's own shingles: short by nature
    lacking = lambda n: n - F.ceil(n * F.lit(threshold) - 1e-9)
    classed = by_item.withColumn("size_class", F.floor(F.log2("total")).cast("int"))
    sized = classed.withColumn("m", (lacking(F.expr("shiftleft(1L, size_class + 1) - 1")) + 1).cast("int"))
    sketch = sized.withColumn("s", F.slice("hs", F.lit(1), F.col("m")))
    least = F.greatest(F.lit(1), F.size("s") - lacking(F.col("total"))).cast("int")
    return sketch.select("size_class", "item_id", "width", least.alias("least"), F.explode("s").alias("h"))


def passes(sizes: dict[int, int], most: int) -> list[tuple[list[int], int, int]]:
    """(size classes, part, parts): classes are looked up together while they have at most ``most`` rows, a larger one in parts."""
    out: list[tuple[list[int], int, int]] = []
    together, rows = [], 0
    for size_class, n in sorted(sizes.items()):
        if n > most:
            parts = -(-2 * n // most)
            out += [([size_class], i, parts) for i in range(parts)]
        elif rows + n > most:
            out.append((together, 0, 1))
            together, rows = [size_class], n
        else:
            together, rows = [*together, size_class], rows + n
    return out + ([(together, 0, 1)] if together else [])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document that holds a share ``threshold`` of an item's shingles.

    Shingles are five words; an item with fewer words is one shingle of all its words. Null and empty
    texts have no shingles and match nothing, as have items of this kind; rows with a null id are left
    out. Rows that repeat a doc_id count as one document with the union of their shingles (items alike).
    Very long texts are read whole, as one array of words. Empty tables give an empty result; other columns are not read.
    """
    n = SHINGLE
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    items = scratch.write(item_shingles(benchmark, n).distinct(), "items")
    items = items.drop("total").distinct().join(items.select("item_id", "shingle").distinct().groupBy("item_id").agg(F.count("*").alias("total")), "item_id")
    found = scratch.write(sketches(items, threshold), "sketches")
    classes = {r["size_class"]: r["n"] for r in found.groupBy("size_class").agg(F.count("*").alias("n")).collect()}  # a row for each power of two
    widths = sorted(r[0] for r in found.select("width").distinct().collect()) or [n]  # at most five numbers
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    split = texts.select("doc_id", words().alias("w"))
    every = F.concat(*(hashes(F.col("w"), k) for k in widths))
    hashed, hits = split.select("doc_id", F.explode(every).alias("h")), None
    for together, part, parts in passes(classes, BROADCAST_ROWS) or [([], 0, 1)]:
        lookup = found.filter(F.col("size_class").isin(together) & (F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)).select("h", "item_id", "least")
        some = hashed.join(F.broadcast(lookup), "h").distinct()  # at most BROADCAST_ROWS rows, but for one item's
        hits = some if hits is None else hits.unionByName(some)
    candidates = scratch.write(hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("k"), F.min("least").alias("least")).filter("k >= least").select("doc_id", "item_id"), "candidates")
    suspects = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words().alias("w"))
    own = suspects.select("doc_id", F.explode(F.array_distinct(F.concat(*(shingles(F.col("w"), k) for k in widths)))).alias("shingle"))
    few = (items.agg(F.sum(F.octet_length("shingle") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    shared = own.join(F.broadcast(items) if few else items, "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.max("total").alias("n_item"))
    exact = shared.join(candidates, ["doc_id", "item_id"], "left_semi")
    share = F.col("n_shared") / F.col("n_item")
    return exact.filter(share >= threshold).select("doc_id", "item_id", "n_item", "n_shared", share.alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay as they are.

    Rows are judged one by one, by their id and a hash of their text: those that share an id aren't one
    document here, and rows without an id are judged too.
    """
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64("text").cast("string"))
    name = fresh(docs, "_leak")
    leaks = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaks, row == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH i AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
it AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM it GROUP BY 1),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM i),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS s FROM d, ks)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM ds JOIN it USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) / n_item >= 0.8
"""
