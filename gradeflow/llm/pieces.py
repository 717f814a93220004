"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut where no piece of the vocabulary crosses, so a corpus has few distinct units. Each distinct
unit's substrings are exploded and equi-joined to the piece table, which gives the edges of its lattice;
edges are grouped by unit (without another shuffle) and folded by a higher-order ``aggregate``. Ids of
units then go back into the texts: the most frequent units by a broadcast of bounded size, the rest by a join.

The fold depends on the model. Viterbi over piece scores is right for a unigram model. The scores of a
byte-pair model are ranks of merges and their best sum isn't its encoding, so for that kind the fold
applies the merges: the state is the set of boundaries, and each step takes the best edge that spans
exactly two neighbouring symbols, the leftmost on a tie.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, fresh, release, table, with_fields, without
from .words import _Powers, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longest unit whose boundaries fit a 64-bit set; longer ones are merged by a heap.
MOST_CHARS = 61
#: Units whose ids are broadcast (some 20 bytes each), and units a task counts before it hands them on.
HOT_UNITS, HELD_UNITS = 4_000_000, 100_000
SPACE = "▁"
_codes = _Powers(np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Vocabulary:
    """Pieces of a model: normal pieces with scores, and ids of bytes."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    first_byte: int

    def __post_init__(self):
        letters = sorted({c for p, ok in zip(self.pieces, self.normal, strict=True) if ok and len(p) > 1 for c in p})
        self.index = np.zeros(0x110000, np.uint16)
        self.index[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        n = len(letters) + 1
        self.starts, self.inner, self.stops, self.three = (np.zeros(shape, bool) for shape in [(n, n)] * 3 + [(n, n, n)])
        for p, ok in zip(self.pieces, self.normal, strict=True):
            if ok and len(p) > 1:
                rows = self.index[[ord(c) for c in p]]
                self.starts[rows[0], rows[1]] = self.stops[rows[-2], rows[-1]] = True
                self.inner[rows[:-1], rows[1:]] = True
                self.three[rows[:-2], rows[1:-1], rows[2:]] = True
        self.longest = max((len(p) for p, ok in zip(self.pieces, self.normal, strict=True) if ok), default=1)

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        return Vocabulary([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], [not x for x in special], model.piece_to_id("<0x00>"))

    def bytes_of(self) -> list[bytes]:
        """What each id stands for in UTF-8; controls stand for nothing."""
        out = []
        for i, (p, ok) in enumerate(zip(self.pieces, self.normal, strict=True)):
            byte = i - self.first_byte
            out.append(p.replace(SPACE, " ").encode() if ok else bytes([byte]) if 0 <= byte < 256 else b"")
        return out

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, starts and ends of their units, and each text's first unit."""
        flat = [(" " + t).replace(" ", SPACE) if t else "" for t in texts]
        codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([0, *map(len, flat)])
        rows = self.index[codes]
        cut = np.ones(len(codes) + 1, bool)
        if len(codes) > 1:
            # a piece across x|y starts at x or holds what stands before it, and ends at y or holds what follows
            x, y = rows[:-1], rows[1:]
            three = np.zeros(len(codes), bool)
            three[1:-1] = self.three[rows[:-2], rows[1:-1], rows[2:]]
            cut[1:-1] = ~(self.inner[x, y] & (self.starts[x, y] | three[:-1]) & (self.stops[x, y] | three[1:]))
        cut[edges] = True
        at = np.flatnonzero(cut)
        return codes, at[:-1], at[1:], np.searchsorted(at[:-1], edges)


def slices(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def unit_prints(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _codes.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > MOST_CHARS).tolist():  # long strings can agree in the polynomial
        out[i] = int.from_bytes(hashlib.blake2b(codes[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _text(codes: np.ndarray, a: int, b: int) -> str:
    return codes[a:b].tobytes().decode("utf-32-le", "surrogatepass")


def merge_long(unit: str, ids: dict[str, tuple[float, int]], first_byte: int) -> list[int]:
    """Byte-pair merges of a unit of any length by a heap."""
    parts, left, right = list(unit), list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0 and (found := ids.get(both := parts[i] + parts[right[i]])):
            heapq.heappush(heap, (-found[0], i, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] and right[i] >= 0 and parts[i] + parts[right[i]] == both:
            j = right[i]
            parts[i], parts[j], right[i] = both, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
    return [x for p in parts if p for x in ([ids[p][1]] if p in ids else [first_byte + b for b in p.encode("utf-8", "surrogatepass")])]


def count_units(docs: DataFrame, shared) -> DataFrame:
    """(unit, n) of the distinct units of ``docs(text)``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held.values()], pa.string()), pa.array([x[1] for x in held.values()], pa.int64())], names=["unit", "n"])
            held.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole)):
            codes, starts, ends, _ = shared.value.units(batch.column(0).to_pylist())
            prints = unit_prints(codes, starts, ends)
            order = np.argsort(prints)
            prints = prints[order]
            heads = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
            prints, at, n = prints[heads], order[heads], np.diff(np.append(heads, len(order)))
            for h, i, k in zip(prints.tolist(), at.tolist(), n.tolist(), strict=True):
                if h in held:
                    held[h][1] += k
                else:
                    held[h] = [_text(codes, starts[i], ends[i]), k]
            if len(held) > HELD_UNITS:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(scan, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, vocabulary: Vocabulary, unigram: bool = False) -> DataFrame:
    """(unit, n, ids) of ``units(unit, n)`` of at most ``MOST_CHARS`` characters.

    An edge is one long: rank of its cost, start, length and id from high to low bits, so that edges sort
    by rank and then from the left. Characters without a piece have id 0 and are spelled in bytes.
    """
    spark = units.sparkSession
    costs = sorted({-s for s, ok in zip(vocabulary.scores, vocabulary.normal, strict=True) if ok})
    place = {c: i for i, c in enumerate(costs)}
    rows = [(p, len(p) << 20 | i | place[-s] << 32, float(-s)) for i, (p, s, ok) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal, strict=True)) if ok]
    pieces = spark.createDataFrame(rows, "piece string, code long, cost double")  # the model's size
    at = units.select("unit", "n", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("a"))
    parts = at.select("unit", "n", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), F.length("unit") - F.col("a") + 1))).alias("k"))
    parts = parts.select("unit", "n", "a", "k", F.expr("substring(unit, a, k)").alias("piece"))
    by_hash = pieces.select(F.xxhash64("piece").alias("h"), F.col("piece").alias("p"), "code", "cost")
    edges = parts.withColumn("h", F.xxhash64("piece")).join(F.broadcast(by_hash), "h", "left").filter("(p is not null and p = piece) or k = 1")
    same = F.col("p").eqNullSafe(F.col("piece"))
    edges = edges.withColumn("code", F.when(same, F.col("code"))).withColumn("cost", F.when(same, F.col("cost")))
    size = F.length("unit").alias("size")
    spelled = f"transform(sequence(1, octet_length(substring(unit, a(e), 1))), i -> cast(conv(hex(substring(encode(substring(unit, a(e), 1), 'UTF-8'), i, 1)), 16, 10) as int) + {vocabulary.first_byte})"
    fields = {"a(e)": "cast(shiftright(e, 26) & 63 as int)", "k(e)": "cast(shiftright(e, 20) & 63 as int)", "id(e)": "cast(e & 1048575 as int)"}

    def of(expression: str):
        for name, field in fields.items():
            expression = expression.replace(name, field)
        return F.expr(expression)

    if unigram:
        best = edges.select("unit", "n", F.struct((F.col("a") + F.col("k")).alias("z"), "a", "k", F.coalesce("cost", F.lit(1e12)).alias("cost"), F.coalesce(F.col("code"), F.lit(1 << 20)).bitwiseOR(F.shiftleft(F.col("a").cast("long"), 26)).alias("e")).alias("e"))
        by_unit = best.groupBy("unit", "n").agg(F.sort_array(F.collect_list("e")).alias("edges")).withColumn("size", size)
        # state: for each end the least cost and the edges to it; edges come by their end
        empty = "cast(array() as array<bigint>) as path"
        fold = f"""aggregate(edges, array_insert(array_repeat(struct(cast(1e300 as double) as cost, {empty}), size), 1, struct(cast(0 as double) as cost, {empty})),
            (s, e) -> if(s[e.a - 1].cost + e.cost < s[e.z - 1].cost, transform(s, (x, i) -> if(i = e.z - 1, struct(s[e.a - 1].cost + e.cost as cost, concat(s[e.a - 1].path, array(e.e)) as path), x)), s), s -> s[size].path)"""
        path = by_unit.withColumn("path", F.expr(fold))
    else:
        code = F.coalesce(F.col("code"), F.lit(1 << 20)).bitwiseOR(F.shiftleft(F.col("a").cast("long"), 26))
        by_unit = edges.select("unit", "n", code.alias("e")).groupBy("unit", "n").agg(F.sort_array(F.collect_list("e")).alias("edges")).withColumn("size", size)
        merges = by_unit.withColumn("m", of("transform(filter(edges, e -> k(e) > 1), e -> struct(shiftleft(1L, a(e) - 1) | shiftleft(1L, a(e) - 1 + k(e)) as ends, shiftleft(shiftleft(1L, k(e) - 1) - 1L, a(e)) as inside))"))
        fold = "aggregate(sequence(1, greatest(1, least(size - 1, size(m)))), shiftleft(1L, size + 1) - 1L, (s, x) -> coalesce(s & ~ get(filter(m, e -> (s & e.ends) = e.ends and bit_count(s & e.inside) = 1), 0).inside, s))"
        done = merges.select("unit", "n", "edges", F.expr(f"if(size(m) = 0, shiftleft(1L, size + 1) - 1L, {fold})").alias("s"))
        # edges on the final boundaries, from the left: the start stands above the length and id
        path = done.withColumn("path", of("array_sort(transform(filter(edges, e -> (s & (shiftleft(1L, a(e) - 1) | shiftleft(1L, a(e) - 1 + k(e)))) = (shiftleft(1L, a(e) - 1) | shiftleft(1L, a(e) - 1 + k(e))) and (s & shiftleft(shiftleft(1L, k(e) - 1) - 1L, a(e))) = 0), e -> e & 4294967295L))"))
    ids = of(f"if(exists(path, e -> id(e) = 0), flatten(transform(path, e -> if(id(e) = 0, {spelled}, array(id(e))))), transform(path, e -> id(e)))")
    return path.select("unit", "n", ids.alias("ids"))


class UnitTable:
    """Sorted fingerprints of units and their ids, packed: some 20 bytes a unit."""

    def __init__(self, prints: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(prints, kind="stable")
        begin = np.cumsum(sizes) - sizes
        self.prints, self.begin, self.sizes, self.ids = prints[order], begin[order].astype(np.uint32), sizes[order].astype(np.uint16), ids
        twice = np.flatnonzero(self.prints[1:] == self.prints[:-1])
        self.sizes[twice] = self.sizes[twice + 1] = 0  # two units of one fingerprint: not found here

        self.slots = None

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and whether they are right; by high bits first, by bisection where two units share those."""
        if not len(self.prints):
            return np.zeros(len(prints), np.int64), np.zeros(len(prints), bool)
        if self.slots is None:  # made in each worker
            self.shift = np.uint64(64 - (len(self.prints).bit_length() + 1))
            self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
            self.slots[self.prints >> self.shift] = np.arange(len(self.prints))
        at = self.slots[prints >> self.shift].astype(np.int64)
        miss = np.flatnonzero(self.prints[at] != prints)
        at[miss] = np.minimum(np.searchsorted(self.prints, prints[miss]), len(self.prints) - 1)
        return at, (self.prints[at] == prints) & (self.sizes[at] > 0)


def text_of(tokens: np.ndarray, meaning: list[bytes]) -> str:
    """What ids stand for, without the space that encoding puts in front."""
    out = b"".join(map(meaning.__getitem__, tokens.tolist()))
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def same(text: str | None, tokens: np.ndarray | None, meaning: list[bytes]) -> bool:
    """Whether ids decode to their text; the escape character itself decodes to a space, by the model's design."""
    return text is None or text_of(tokens, meaning) == text.replace(SPACE, " ")


def encode(docs: DataFrame, model: str = MODEL, hot_units: int = HOT_UNITS) -> DataFrame:
    """All columns of ``docs`` and ``tokens`` array<int>, ``n_tokens``, ``round_trip`` from its ``text``; columns of these names are replaced.

    ``round_trip`` says whether the ids, decoded, give the text.

    The ids are those of the model's own encoder. A null text has null tokens and 0, an empty one an
    empty list. Repeated rows get the same ids, an empty table gives an empty result. A very long text is
    encoded whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "pieces")
    vocabulary = Vocabulary.load(model)
    shared = spark.sparkContext.broadcast(vocabulary)
    docs = docs.select(*(f"`{c}`" for c in without(docs, ("tokens", "n_tokens", "round_trip"))))
    cold_name, row_name, ids_name = fresh(docs, "_cold"), fresh(docs, "_row"), fresh(docs, "_ids")
    meaning = spark.sparkContext.broadcast(vocabulary.bytes_of())
    ids = {p: (s, i) for i, (p, s, ok) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal, strict=True)) if ok}
    first_byte = vocabulary.first_byte
    units = scratch.write(count_units(docs, shared), "units")

    def long_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([merge_long(u, ids, first_byte) for u in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["unit", "n", "ids"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    short = units.filter(F.length("unit") <= MOST_CHARS).repartition(tasks, "unit")
    known = lattice(short, vocabulary).unionByName(units.filter(F.length("unit") > MOST_CHARS).mapInArrow(long_units, "unit string, n long, ids array<int>"))
    known = scratch.write(known, "known")
    least, total = 1, 0
    by_count = known.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toArrow().to_pylist()  # as many rows as distinct counts
    for row in by_count:
        total += row["k"]
        if total > hot_units:
            least = row["n"] + 1
            break

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).to_pylist()
            codes = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
            edges = np.cumsum([0, *map(len, text)])
            lists = batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(unit_prints(codes, edges[:-1], edges[1:]).view(np.int64)), pa.array(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)), pa.array([np.asarray(x.values, np.int32).tobytes() for x in lists], pa.binary())], names=["h", "k", "ids"])

    got = known.filter((F.col("n") >= least) & (F.size("ids") < 65536)).select("unit", "ids").mapInArrow(packed, "h long, k int, ids binary").toArrow()  # at most hot_units rows
    kind = np.uint16 if len(vocabulary.pieces) < 65536 else np.int32
    parts = [np.zeros(0, kind)]
    for chunk in got.column(2).chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(np.int32).astype(kind))
    prints, sizes, n_got = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy(), got.num_rows
    del got
    release()
    hot = UnitTable(prints, sizes, np.concatenate(parts))
    del parts, prints, sizes
    covered = least == 1 and n_got == total and not len(np.flatnonzero(hot.sizes == 0))  # units of 65,536 ids or more aren't in the table
    hot_shared = spark.sparkContext.broadcast(hot)
    del hot
    release()
    names = docs.columns

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_known = hot_shared.value
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            codes, starts, ends, first = shared.value.units(texts)
            at, hit = units_known.find(unit_prints(codes, starts, ends))
            missed = np.concatenate([[0], np.cumsum(~hit)])
            miss = missed[first[1:]] - missed[first[:-1]]
            sizes, begin = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            sizes[hit], begin[hit] = units_known.sizes[at[hit]], units_known.begin[at[hit]]
            ends_of = np.concatenate([[0], np.cumsum(sizes)])
            begin = np.repeat(begin, sizes)
            values = units_known.ids[begin + np.arange(len(begin)) - np.repeat(ends_of[:-1], sizes)].astype(np.int32) if len(begin) else np.zeros(0, np.int32)
            bad = [t is None or m > 0 for t, m in zip(texts, miss.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends_of[first].astype(np.int32)), pa.array(values), mask=pa.array(bad, pa.bool_()))
            counts = np.where(bad, 0, ends_of[first[1:]] - ends_of[first[:-1]])
            cold = [[_text(codes, starts[i], ends[i]) for i in first[d] + np.flatnonzero(~hit[first[d] : first[d + 1]])] if m else None for d, m in enumerate(miss.tolist())]
            cold = [sorted(set(x)) if x else None for x in cold]
            edges = ends_of[first].tolist()
            agree = [None if m else same(t, values[a:b], meaning.value) for t, m, a, b in zip(texts, miss.tolist(), edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(counts, pa.int64()), pa.array(agree, pa.bool_()), pa.array(cold, pa.list_(pa.string()))], names=[*names, "tokens", "n_tokens", "round_trip", cold_name])

    encoded = docs.mapInArrow(first_pass, with_fields(docs, f"tokens array<int>, n_tokens long, round_trip boolean, {cold_name} array<string>"))
    if covered:
        return encoded.drop(cold_name)
    encoded = scratch.write(encoded.withColumn(row_name, F.monotonically_increasing_id()), "encoded")
    is_cold = F.col(cold_name).isNotNull()
    rest = encoded.filter(is_cold).select(F.col(row_name).alias("r"), F.explode(cold_name).alias("unit")).join(known.select("unit", "ids"), "unit")
    rest = rest.groupBy(F.col("r").alias(row_name)).agg(F.collect_list(F.struct("unit", "ids")).alias(ids_name))  # a text's own units

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_known = hot_shared.value
        for batch in batches:
            out, agree = [], []
            for text, own in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index(ids_name)).to_pylist(), strict=True):
                more = {x["unit"]: x["ids"] for x in own}
                codes, starts, ends, _ = shared.value.units([text])
                at, hit = units_known.find(unit_prints(codes, starts, ends))
                tokens: list[int] = []
                for i, (j, ok) in enumerate(zip(at.tolist(), hit.tolist(), strict=True)):
                    b = int(units_known.begin[j]) if ok else 0
                    tokens += units_known.ids[b : b + int(units_known.sizes[j])].tolist() if ok else more[_text(codes, starts[i], ends[i])]
                out.append(tokens)
                agree.append(same(text, np.array(tokens, np.int32), meaning.value))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.list_(pa.int32())), pa.array([len(x) for x in out], pa.int64()), pa.array(agree, pa.bool_())], names=[*names, "tokens", "n_tokens", "round_trip"])

    late = encoded.filter(is_cold).drop("tokens", "n_tokens", "round_trip", cold_name).join(rest, row_name).drop(row_name).mapInArrow(second_pass, with_fields(docs, "tokens array<int>, n_tokens long, round_trip boolean"))
    return encoded.filter(~is_cold).drop(cold_name, row_name).unionByName(late)


def decode(rows: DataFrame, model: str = MODEL, column: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text that ``tokens`` stands for; null tokens give null."""
    spark = rows.sparkSession
    bounded_batches(spark)
    meaning = spark.sparkContext.broadcast(Vocabulary.load(model).bytes_of())
    rows = rows.select(*(f"`{c}`" for c in without(rows, (column.lower(),))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("tokens"))
            texts = [text_of(x.values.to_numpy(), meaning.value) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, column])

    return rows.mapInArrow(scan, with_fields(rows, f"{column} string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "tokens", "round_trip")
