"""Jaccard join of shingle sets with adaptive multi-match prefixes, down to groups of linked documents.

Equal sets form a class, and classes are joined. All classes order their shingles alike: rare ones first
by a sketch of counts over all documents, then by fingerprint. Two sets of which each needs at least
tau = ceil(0.8 n) common elements share l elements among their first n - tau + l, for any l up to tau. Each
class picks its own l by the estimated cost of its candidates: a longer prefix costs more lookups but
asks for more matches before a pair is verified. A pair is judged at the smaller of its two l.

Groups are found without listing all pairs within them. First each class is verified against one hub: of
the classes that stand highest on its shingles by the company that their prefixes have, the one with which
it shares most prefix shingles. Linked classes are merged. Then every
remaining candidate pair between different groups is verified on whole sets, so no link that would join
two groups is missed. Shingles on which many classes meet make no pairs: their classes are compared in
blocks of bounded size, of which only links between groups come out. Only the texts of classes that can have a candidate are shuffled.

Fingerprints have 64 bits. A link found by them is confirmed on the words themselves, and a class is told
from others by 128 bits of two independent families of fingerprints.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, bounded_batches, release, table
from .components import components
from .words import LOWER, Words, as_long, run_prints, words_of

SHINGLE, PERCENT = 5, 80
#: Slots of the sketch of shingle counts, longest l, and the cost of verifying a pair in lookups.
SLOTS, MOST_MATCHES, VERIFY_COST = 1 << 22, 16, 50.0
#: Other documents that are taken to share a shingle whose count does not stand out of the sketch's noise.
UNSEEN = 0.05
#: Parts in which a task hands over its sketch, and streams in which each part is first summed.
PARTS, STREAMS = 64, 8


def sets_of(words: Words, n: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, sorted distinct fingerprints) of every text; of all its words if there are fewer than ``n``."""
    runs = run_prints(words.prints, n)
    for i, (a, count) in enumerate(zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True)):
        if count >= n:
            yield words.rows[i], np.unique(runs[a : a + count - n + 1])
        else:
            yield words.rows[i], run_prints(words.prints[a : a + count], count) if count else np.zeros(0, np.uint64)


#: Sketch counts are kept as logarithms in steps of 1 / LOG, so that 16 bits hold any count.
LOG = 1024.0


def digest_of(prints: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(prints.tobytes(), digest_size=8).digest(), "little", signed=True)


def second_digest(words: Words, i: int, n: int = SHINGLE) -> int:
    """Of the set of the chunk's text ``i`` by the second family."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    return digest_of(np.unique(run_prints(words.second(a, b), min(n, b - a), 1)))


_LOWER = bytes(LOWER)


def shingles(text: str, n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The set of a text in words."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set()


def linked(a: set, b: set) -> bool:
    common = len(a & b)
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


#: Classes on a shingle above which they are compared in blocks, bytes of text in a block, and pairs of blocks for a task.
CROWD, BLOCK_BYTES, BLOCK_PAIRS = 300, 128 << 10, 64


def needed(n: int) -> int:
    """Common elements that a link asks of a set of size n at least."""
    return -(-PERCENT * n // 100)


def prefix_of(prints: np.ndarray, slots: np.ndarray, noise: float) -> tuple[np.ndarray, int, np.ndarray]:
    """Prefix shingles in the common order, the class's l, and the least l at which each is in the prefix."""
    n, rank = len(prints), slots[(prints & np.uint64(len(slots) - 1)).astype(np.int64)]
    base = n - needed(n) + 1
    most = min(MOST_MATCHES, needed(n))
    order = np.argsort(rank, kind="stable")[: base + most - 1]  # prints are sorted
    cost = np.cumsum(np.maximum(UNSEEN, np.exp2(rank[order] / LOG) - 1.0 - noise))[base - 1 :]
    ells = np.arange(1, len(cost) + 1)
    ell = int(np.argmin(cost + VERIFY_COST * cost / ells + 0.5 * ells)) + 1
    order = order[: base + ell - 1]
    return prints[order], ell, np.maximum(1, np.arange(1, len(order) + 1) - base + 1)


def _scan(docs: DataFrame, schema: str, of_set, at_end=None, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """Rows that ``of_set(state, (doc_id, key), prints, cls, alt)`` returns for each document and ``at_end(state)`` at a task's end.

    ``cls`` is the digest of the set (None if it is empty), or where that is one of ``clashes`` the digest by
    the second family, which ``alt()`` returns for any set.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            ids, rows = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), []
            for words in words_of(batch.column(1), lower=True):
                for i, prints in sets_of(words):
                    alt = functools.partial(second_digest, words, i - words.rows.start)
                    cls = digest_of(prints) if len(prints) else None
                    rows += of_set(state, ids[i], prints, alt() if cls in clashes else cls, alt)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for columns in at_end(state) if at_end else ():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.mapInArrow(scan, schema)


def near_groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``.

    Words are runs of non-blank characters, A-Z in lower case. Null, empty and blank texts have no
    shingles and are their own component. Repeated rows are in one component, and texts of equal sets are
    too; a null id gives a null component only where no row of the component has an id. A very long text
    is read whole, in one piece of its own. Empty tables give an empty result, and other columns are not read.
    """
    by_row, roots = _groups(docs, scratch or Scratch(docs.sparkSession, "near"))
    named = by_row.join(roots.select("label", F.col("first.doc_id").alias("root")), "label", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("root")).alias("component_id"))


def _groups(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, label) of every row, label null without shingles, and (label, first, rows): the first (none, doc_id, key) and the number of rows of each label."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) key")  # a row is known by its id and a hash of its text

    def sketch(state, doc_id, prints, cls, alt):
        if len(prints):
            if "n" not in state:
                state["n"] = np.zeros(SLOTS, np.int32)
            state["n"][(prints & np.uint64(SLOTS - 1)).astype(np.int64)] += 1  # slots that two shingles of a text share count once
        return [(doc_id[0], len(prints), cls, None if cls is None else alt(), doc_id[1], None, None)]

    def counts(state):
        if "n" in state:
            parts = np.minimum(state["n"], 255).astype(np.uint8).reshape(PARTS, -1)  # a task's count of one slot: an ordering needs no more
            yield *([None] * PARTS for _ in range(5)), list(range(PARTS)), [zlib.compress(x.tobytes(), 1) for x in parts]

    scanned = scratch.write(_scan(docs, "doc_id long, n long, cls long, alt long, key long, part int, counts binary", sketch, counts), "sizes")
    shared = spark.sparkContext.broadcast(_summed(scanned.filter("part is not null").select("part", "counts")))
    several = scanned.filter("cls is not null").groupBy("cls").agg(F.min("alt").alias("a"), F.max("alt").alias("b")).filter("a <> b").select("cls")
    clashes = frozenset(r["cls"] for r in several.collect())  # 64-bit clashes of different sets: of n sets some n**2 / 2**65
    sizes = scanned.filter("part is null").select("doc_id", "key", "n", (F.when(F.col("cls").isin(*clashes), F.col("alt")).otherwise(F.col("cls")) if clashes else F.col("cls")).alias("cls"))

    def tokens(state, doc_id, prints, c, alt):
        if c is None or c in (seen := state.setdefault("seen", set())):
            return []
        seen.add(c)
        first, _, _ = prefix_of(prints, *shared.value)
        return [(as_long(first).tolist(),)]

    flat = _scan(docs, "t array<long>", tokens, clashes=clashes).select(F.explode("t").alias("t"))
    often = scratch.write(flat.groupBy("t").agg(F.count("*").alias("n")).filter("n > 1").select("t"), "often")
    filter_bits = spark.sparkContext.broadcast(bloom.build(often, "t"))

    def entries(state, doc_id, prints, c, alt):
        if c is None or c in (seen := state.setdefault("seen", set())):
            return []
        seen.add(c)
        first, ell, level = prefix_of(prints, *shared.value)
        hit = bloom.contains(filter_bits.value, first)
        return [(c, len(prints), ell, as_long(first[hit]).tolist(), level[hit].tolist())] if hit.any() else []

    raw = _scan(docs, "cls long, n long, ell int, t array<long>, level array<int>", entries, clashes=clashes)
    lists = raw.select("cls", "n", "ell", F.explode(F.arrays_zip("t", "level")).alias("x")).select(F.col("x.t").alias("t"), "cls", "n", "ell", F.col("x.level").alias("level"))
    lists = lists.groupBy("t", "cls").agg(*(F.first(c).alias(c) for c in ("n", "ell", "level")))
    lists = scratch.write(lists, "lists")
    for done in (shared, filter_bits):
        done.destroy()
    release()
    lists = scratch.write(_meeting(lists), "meeting")
    scratch.drop("often", "lists")
    texts = _texts(docs, sizes, lists, scratch)

    pairs = scratch.write(_hub_pairs(lists), "hubs")
    links = scratch.write(_verified(pairs, texts), "found")
    label = scratch.write(components(links, scratch, "hub_stars"), "labels")
    own = scratch.write(_labelled(lists, label), "apart")
    crowded = scratch.write(own.groupBy("t").agg(F.count("*").alias("k"), F.max(F.struct("score", "cls")).alias("h")).filter(F.col("k") > CROWD).select("t", F.col("h.cls").alias("hub")), "crowded")
    others = scratch.write(_cross_pairs(own.join(crowded, "t", "left_anti")).join(pairs, ["u", "v"], "left_anti"), "cross")
    within = scratch.write(_block_links(own.join(crowded, "t").select("hub", "cls", "label").distinct(), texts), "block_links")
    label = components(links.unionByName(_verified(others, texts)).unionByName(within), scratch, "stars")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    by_class = sizes.filter("cls is not null").groupBy("cls").agg(first, F.count("*").alias("rows")).join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    by_class = scratch.write(by_class, "classes")
    roots = scratch.write(by_class.groupBy("label").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")), "roots")  # a table, so that a hot label's rows can be split
    return sizes.join(by_class.select("cls", "label"), "cls", "left").select("doc_id", "key", "n", "label"), roots


def _summed(parts: DataFrame) -> tuple[np.ndarray, float]:
    """Logarithms of the sketch of all tasks, and its median: parts are summed in streams, then over streams; 8 bytes a slot reach the driver, part by part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zlib.decompress(counts)
                values = np.frombuffer(raw, np.uint8 if len(raw) == SLOTS // PARTS else np.int64)
                sums[part] = sums.get(part, 0) + values.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["part", "counts"])

    streams = parts.withColumn("s", F.spark_partition_id() % STREAMS).repartition("part", "s").select("part", "counts")
    total = np.zeros((PARTS, SLOTS // PARTS), np.uint32)
    for row in streams.mapInArrow(add, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary").collect():  # PARTS compressed rows
        total[row["part"]] = np.minimum(total[row["part"]] + np.frombuffer(zlib.decompress(row["counts"]), np.int64), 0xFFFFFFFF)
    logs = np.zeros(total.shape, np.uint16)
    for i in range(PARTS):
        logs[i] = np.log2(1.0 + total[i]) * LOG
    return logs.ravel(), float(np.median(total))


def _meeting(lists: DataFrame) -> DataFrame:
    """Entries of shingles on which several classes meet, with the least l there (``m``) and the class's score.

    The score is how much company a class's prefix has: the original of many copies has most.
    """
    by_shingle = lists.groupBy("t").agg(F.count("*").alias("df"), F.min("ell").alias("m")).filter("df > 1")
    met = lists.join(by_shingle, "t")
    score = met.groupBy("cls", "n").agg(F.sum("df").alias("df")).select("cls", (F.col("df") / F.col("n")).alias("score"))
    return met.drop("df").join(score, "cls")


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    """Entries with their group; only shingles on which several groups meet."""
    own = lists.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    several = own.groupBy("t").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("t")
    return own.join(several, "t", "left_semi")


def _texts(docs: DataFrame, sizes: DataFrame, lists: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, text): one text of each class that can be in a candidate pair.

    A pair is judged at the smaller l of its classes, so a class with fewer prefix shingles in company
    than its own l and than the least l on any of them is in no pair.
    """
    able = lists.groupBy("cls").agg(F.count("*").alias("k"), F.min("m").alias("m")).filter("k >= m").select("cls")
    one = sizes.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("key", "doc_id")).alias("r")).join(able, "cls", "left_semi")
    one = scratch.write(one.select("cls", F.col("r.key").alias("key"), F.col("r.doc_id").alias("doc_id")), "able")
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(one, "key"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.contains(bits.value, batch.column("key").to_numpy().view(np.uint64))))

    found = docs.select("key", "doc_id", "text").mapInArrow(wanted, "key long, doc_id long, text string").alias("d").join(one.alias("o"), F.expr("d.key = o.key and d.doc_id <=> o.doc_id"))
    found = scratch.write(found.select("o.cls", "d.text"), "texts")
    bits.destroy()
    n, distinct = found.agg(F.count("cls"), F.countDistinct("cls")).first()
    return found if n == distinct else scratch.write(found.dropDuplicates(["cls"]), "single_texts")


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """(u, v), u < v: each class with the hub that it shares most prefix shingles with, if those are enough for a candidate."""
    hubs = lists.groupBy("t").agg(F.max(F.struct("score", "cls", "n", "ell", "level")).alias("h"))
    near = lists.join(hubs, "t").filter("cls <> h.cls and 100 * least(n, h.n) >= 80 * greatest(n, h.n)")
    ell = F.least("ell", "h.ell")
    counted = near.filter(F.greatest("level", "h.level") <= ell).groupBy("cls", F.col("h.cls").alias("hub")).agg(F.count("*").alias("k"), F.first(ell).alias("m")).filter("k >= m")
    best = counted.groupBy("cls").agg(F.max(F.struct("k", "hub")).alias("h"))
    return best.select(F.least("cls", "h.hub").alias("u"), F.greatest("cls", "h.hub").alias("v")).distinct()


def _block_links(crowds: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) links between groups among the classes of each crowd: those outside its largest group against all.

    Both sides are cut into blocks of about ``BLOCK_BYTES``; a class has at most one link to each group from a block.
    A crowd of many blocks is dealt out: each task meets all blocks of the second side with some of the first.
    """
    rows = crowds.join(texts, "cls").withColumn("bytes", F.octet_length("text") + 64)
    big = rows.groupBy("hub", "label").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes")).groupBy("hub").agg(F.max(F.struct("k", "label", "bytes")).alias("b"), F.sum("bytes").alias("all"))
    big = big.select("hub", F.col("b.label").alias("big"), F.ceil((F.col("all") - F.col("b.bytes")) / BLOCK_BYTES).alias("n_a"), F.ceil(F.col("all") / BLOCK_BYTES).alias("n_b")).filter("n_a > 0")
    rows = rows.join(big.withColumn("parts", F.least("n_a", F.ceil(F.col("n_a") * F.col("n_b") / BLOCK_PAIRS)).cast("int")), "hub")

    def blocks(some: DataFrame, total: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("cls"), F.col(total))
        return some.groupBy("hub", "parts", block.alias(f"block_{name}")).agg(F.collect_list(F.struct("cls", "label", "text")).alias(name))

    first = blocks(rows.filter("label <> big"), "n_a", "a").select("hub", F.pmod("block_a", "parts").cast("int").alias("part"), "a")
    second = blocks(rows, "n_b", "b").select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "b")
    both = first.join(second, ["hub", "part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                out += _links_of(a.values, b.values)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return both.select("a", "b").mapInArrow(compare, "u long, v long").distinct()


def _links_of(a: pa.StructArray, b: pa.StructArray) -> list[tuple[int, int]]:
    """Links between the classes of two blocks that have different labels."""
    sets, sizes, owner = [], [], []
    for side in (a, b):
        own = [x for words in words_of(side.field("text"), lower=True) for _, x in sets_of(words)]
        sizes.append(np.array([len(x) for x in own]))
        sets.append(np.concatenate(own))
        owner.append(np.repeat(np.arange(len(own)), sizes[-1]))
    order = np.argsort(sets[1], kind="stable")
    values, theirs = sets[1][order], owner[1][order]
    low, high = np.searchsorted(values, sets[0], "left"), np.searchsorted(values, sets[0], "right")
    n = high - low
    mine = np.repeat(owner[0], n)
    at = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    common = np.bincount(mine * len(b) + theirs[at], minlength=len(a) * len(b)).reshape(len(a), len(b))
    label_a, label_b = a.field("label").to_numpy(), b.field("label").to_numpy()
    near = (100 * common >= PERCENT * (sizes[0][:, None] + sizes[1][None, :] - common)) & (label_a[:, None] != label_b[None, :])
    cls_a, cls_b, out = a.field("cls").to_numpy(), b.field("cls").to_numpy(), []
    text_a, text_b = a.field("text"), b.field("text")
    for i in np.flatnonzero(near.any(1)).tolist():
        own, done = shingles(text_a[i].as_py()), set()
        for j in np.flatnonzero(near[i]).tolist():
            if label_b[j] not in done and linked(own, shingles(text_b[j].as_py())):
                done.add(label_b[j])
                out.append((int(cls_a[i]), int(cls_b[j])))
    return out


def _cross_pairs(own: DataFrame) -> DataFrame:
    """(u, v) of every candidate pair of classes in different groups.

    On each shingle the group with most entries meets all others, and the others meet one another; the
    entries of one group never meet.
    """
    big = own.groupBy("t", "label").agg(F.count("*").alias("k")).groupBy("t").agg(F.max(F.struct("k", "label")).alias("b")).select("t", F.col("b.label").alias("big"))
    own = own.join(big, "t")
    a, b = own.filter("label <> big").alias("a"), own.alias("b")
    pairs = a.join(b, F.expr("a.t = b.t and a.label <> b.label and (b.label = a.big or a.cls < b.cls) and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)"))
    ell = F.least("a.ell", "b.ell")
    counted = pairs.filter(F.greatest("a.level", "b.level") <= ell).groupBy(F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v")).agg(F.count("*").alias("k"), F.first(ell).alias("ell"))
    return counted.filter("k >= ell").select("u", "v")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` that link: 100 * common >= 80 * union, on their whole sets, by fingerprints and then by words."""
    left, right = texts.select(F.col("cls").alias("u"), F.col("text").alias("a")), texts.select(F.col("cls").alias("v"), F.col("text").alias("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([x for words in words_of(batch.column(c), lower=True) for _, x in sets_of(words)] for c in ("a", "b"))
            keep = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                near = 100 * common >= PERCENT * (len(x) + len(y) - common)
                keep.append(near and linked(shingles(batch.column("a")[i].as_py()), shingles(batch.column("b")[i].as_py())))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(verify, "u long, v long")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked documents; all columns stay as they are.

    That of the smallest id stays, a null id after all others, on a tie that of the smallest text hash; of
    rows that share both one stays. Rows without shingles are in no group and stay.
    """
    scratch = Scratch(docs.sparkSession, "near")
    by_row, roots = _groups(docs, scratch)
    several = by_row.join(roots.filter("rows > 1"), "label")
    judged = scratch.write(several.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first((F.col("first.key") == F.col("key")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))).alias("stays")), "judged")
    marked = docs.alias("d").join(judged.filter("not stays").alias("j"), (F.col("j.key") == F.xxhash64("d.text")) & F.col("j.doc_id").eqNullSafe(F.col("d.doc_id").cast("long")), "left_anti").select("d.*")
    twice = judged.filter("stays and n > 1")
    if twice.isEmpty():
        return marked
    on = (F.col("j.key") == F.xxhash64("d.text")) & F.col("j.doc_id").eqNullSafe(F.col("d.doc_id").cast("long"))
    single = marked.alias("d").join(twice.alias("j"), on, "left_anti").select("d.*")
    repeated = marked.alias("d").join(twice.alias("j"), on, "left_semi").select("d.*")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


#: For tables of the size of the checks: it lists all links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + k - 1], ' ')) AS h FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT doc_id, w, least(len(w), 5) AS k FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.v FROM r JOIN l ON r.b = l.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""
