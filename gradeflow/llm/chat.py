"""Chat formatting as a prefix tree: turns that conversations share from their start on are emitted once.

A node of the tree is a turn together with all turns before it, known by running sums of digests. The smallest
conversation that passes through a node owns it, so each conversation owns the last part of its path, a chain,
or nothing if it is a copy or the beginning of another. A chain and all that hangs on it follow each other
depth-first: first the chain, then what branches off it, deepest branch first. So a chain is one stretch of the
packed stream, and the tokens that it may attend to are few stretches: what the owners of the turns before it emit
up to the branch, each an interval of the stream. Position ids go on from where the path branched off.

No tree meets in one task, only a conversation does: owners are a minimum a node, a path is its conversation's
rows grouped by owner, and places in the stream are sums before each chain in the order of its branches, an array
that Spark sorts by range. Tables of owners, paths and chains are written, so joins on turns that very many
conversations share can be split.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash is put into each ``<|``, one more
where there are some (``<\\|``), so control strings never stand in them, and reading takes one away again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table
from .secrets import TOKENIZERS, encoder

#: Control strings and their token ids, the first two that a vocabulary of 50,257 leaves free.
START, END = "<|im_start|>", "<|im_end|>"
START_ID, END_ID = 50_257, 50_258
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
TRAINED = "assistant"
#: Sorts after every id, for rows without one.
NO_ID = "10000000000000000000"
_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles end at the first line break, so theirs are written as ``\\n``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def encode_turn(role: str, text: str, encode) -> tuple[list[int], list[bool]]:
    """Token ids of a turn, and which of them are trained on: the text's, if the assistant wrote it."""
    head, body, tail = [START_ID, *encode(escape_role(role) + "\n")], encode(escape(text)), [END_ID, *encode("\n")]
    return head + body + tail, [False] * len(head) + [role == TRAINED] * len(body) + [False] * len(tail)


def decode(ids: list[int], trained: list[bool], tokens) -> tuple[str, list[tuple[str, str]], list[str]]:
    """The formatted text, its turns, and the texts under the mask, from token ids and mask alone.

    ``tokens`` is a vocabulary: it has ``decode_bytes``. A stretch under the mask is a text of its own.
    """
    read = lambda part: tokens.decode_bytes(part).decode()
    formatted, turns, at = [], [], 0
    while at < len(ids):
        if ids[at] != START_ID:
            upto = next((i for i in range(at, len(ids)) if ids[i] == START_ID), len(ids))
            formatted.append(read(ids[at:upto]))
            at = upto
            continue
        end = ids.index(END_ID, at)
        inner = read(ids[at + 1 : end])
        role, _, text = inner.partition("\n")
        turns.append((unescape_role(role), unescape(text)))
        formatted += [START, inner, END]
        at = end + 1
    mask = np.flatnonzero(np.diff(np.array([False, *trained, False], np.int8)))
    texts = [unescape(read(ids[a:b])) for a, b in mask.reshape(-1, 2).tolist()]
    return "".join(formatted), turns, texts


def vocabulary_file(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        return file.read()


@dataclass
class Packed:
    """The packed stream and who reads what of it.

    ``chains``: one row a stretch of the stream: chain (the owner's number), tree (that of the first chain of its
    tree), start (its place in the stream of all trees), first_turn, token_ids, loss_mask, position_ids, turn_ends
    (tokens of the chain up to the end of each of its turns), attends (intervals of the stream before the chain that
    its tokens attend to, beside their own chain up to themselves).
    ``members``: one row a conversation: conv_id, n_turns, path (chain, start, tokens: first ones of that chain).
    """

    chains: DataFrame
    members: DataFrame


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, conv_id, k, node, role, text): turns numbered from 0 by (turn, role, text), and the node each one ends at.

    The node is a digest of six sums over the turns so far, of 40 bits each of a digest of place, role and text.
    """
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)")).alias("c"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("k", F.row_number().over(order) - 1)
    digest = F.sha2(F.concat_ws(":", "k", F.length("role"), "role", "text"), 256)
    rows = rows.withColumn("_d", digest)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(F.conv(F.substring("_d", 10 * i + 1, 10), 16, 10).cast("long")).over(so_far) for i in range(6)]
    return rows.select("c", "conv_id", "k", F.unhex(F.sha2(F.concat_ws(":", *sums), 256)).alias("node"), "role", "text")


def encoded(turns: DataFrame, vocabulary: bytes) -> DataFrame:
    """(c, k, ids, trained) of ``turns(c, k, role, text)``."""
    shared = turns.sparkSession.sparkContext.broadcast(vocabulary)  # a file of about a megabyte

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_ordinary
        for batch in batches:
            out = [encode_turn(r, t, encode) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([m for _, m in out], pa.list_(pa.bool_()))], names=["c", "k", "ids", "trained"])

    return turns.select("c", "k", "role", "text").mapInArrow(scan, "c decimal(20,0), k int, ids array<int>, trained array<boolean>")


def starts(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, tree, start) of ``chains(c, branches, n)``: the sum of ``n`` before each chain in the order of ``branches``.

    Chains are dealt out by range; what stands before a range is one number for each, summed on the driver.
    """
    spark = chains.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.write(chains.repartitionByRange(parts, "branches").withColumn("_range", F.spark_partition_id()), "order")
    before, so_far = [], 0
    for r in sorted(dealt.groupBy("_range").agg(F.sum("n").alias("n")).collect()):
        before.append((r["_range"], so_far))
        so_far += r["n"]
    own = F.sum("n").over(Window.partitionBy("_range").orderBy("branches").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.join(F.broadcast(spark.createDataFrame(before, "_range int, _before long")), "_range")
    return placed.select("c", F.col("branches")[0]["m"].alias("tree"), (F.col("_before") + own - F.col("n")).alias("start"))


def pack(conversations: DataFrame, vocabulary: bytes | None = None) -> Packed:
    """Formats ``conversations(conv_id, turn, role, text)`` as one stream of tokens in which each shared turn stands once.

    Rows of one conv_id are a conversation, ordered by turn, null turns last, ties by role and text; rows without a
    conv_id are one conversation together. Null roles and texts count as empty. Repeated rows are turns of their own.
    Copies of a conversation are one path. Very long texts are encoded whole. No rows give empty tables. Other columns
    are not read.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "chat")
    turns = scratch.write(turns_of(conversations), "turns")
    owners = scratch.write(turns.groupBy("node").agg(F.min("c").alias("m")), "owners")
    steps = turns.select("c", "k", "node").join(owners.hint("merge"), "node")
    # along a path owners only grow, so turns of one owner follow each other
    path = scratch.write(steps.groupBy("c", "m").agg(F.min("k").alias("first"), F.max("k").alias("last")), "path")
    own = path.filter("c = m").select("c", F.col("first").alias("first_turn"))
    mine = turns.join(own.hint("merge"), "c").filter("k >= first_turn")
    tokens = encoded(mine, vocabulary_file() if vocabulary is None else vocabulary).withColumn("n", F.size("ids"))
    tokens = tokens.withColumn("end", F.sum("n").over(Window.partitionBy("c").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chain = tokens.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "end", "ids", "trained"))).alias("t"))
    chain = chain.select("c", F.col("t")[0]["k"].alias("first_turn"), F.flatten("t.ids").alias("token_ids"), F.flatten("t.trained").alias("loss_mask"), F.col("t.end").alias("turn_ends"))
    chain = scratch.write(chain, "tokens")
    branches = path.join(own.select("c").hint("merge"), "c", "left_semi").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("first", "m"))).alias("s"))
    branches = branches.select("c", F.transform("s", lambda x: F.struct((-x["first"]).alias("b"), x["m"].alias("m"))).alias("branches"))
    sizes = chain.select("c", F.size("token_ids").cast("long").alias("n"))
    place = starts(branches.join(sizes, "c"), scratch)
    meta = scratch.write(chain.select("c", "first_turn", "turn_ends").join(place, "c"), "places")
    of = meta.select(F.col("c").alias("m"), "first_turn", "turn_ends", "start")
    parts = path.join(of.hint("merge"), "m").select("c", "m", "first", "last", "start", F.get("turn_ends", F.col("last") - F.col("first_turn")).alias("tokens"))
    parts = parts.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("first", "m", "start", "tokens"))).alias("path"), (F.max("last") + 1).cast("long").alias("n_turns"))
    parts = scratch.write(parts, "members")
    before = F.filter("path", lambda x: x["m"] != F.col("c"))
    chains = chain.join(meta.select("c", "tree", "start"), "c").join(parts.select("c", before.alias("_before")), "c")
    at = F.aggregate("_before", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    chains = chains.withColumn("_at", at).select(
        F.col("c").alias("chain"),
        "tree",
        "start",
        "first_turn",
        "token_ids",
        "loss_mask",
        F.sequence(F.col("_at"), F.col("_at") + F.size("token_ids") - 1).alias("position_ids"),
        "turn_ends",
        F.transform("_before", lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["tokens"]).alias("end"))).alias("attends"),
    )
    members = parts.select(F.when(F.col("c") < F.lit(NO_ID).cast("decimal(20,0)"), F.col("c").cast("long")).alias("conv_id"), "c", "n_turns", F.transform("path", lambda x: F.struct(x["m"].alias("chain"), x["start"].alias("start"), x["tokens"].alias("tokens"))).alias("path"))
    return Packed(scratch.write(chains, "chains"), members)


def read_back(packed: Packed, vocabulary: bytes | None = None) -> DataFrame:
    """(conv_id, formatted, turns, trained): each conversation from the tokens on its path; ``trained`` are the texts under the mask."""
    pieces = packed.members.select("conv_id", "c", F.posexplode("path").alias("i", "x")).select("conv_id", "c", "i", F.col("x.chain").alias("chain"), F.col("x.tokens").alias("n"))
    got = pieces.join(packed.chains.select("chain", "token_ids", "loss_mask").hint("merge"), "chain")
    got = got.select("conv_id", "c", F.struct("i", F.slice("token_ids", 1, F.col("n").cast("int")).alias("ids"), F.slice("loss_mask", 1, F.col("n").cast("int")).alias("mask")).alias("p"))
    whole = got.groupBy("c", "conv_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("conv_id", F.flatten("p.ids").alias("ids"), F.flatten("p.mask").alias("mask"))
    spark = whole.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_file() if vocabulary is None else vocabulary)
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(shared.value)
        for batch in batches:
            out = [decode(ids, mask, tokens) for ids, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            turns = [[{"role": r, "text": t} for r, t in x] for _, x, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _, _ in out], pa.string()), pa.array(turns, pa.list_(turn)), pa.array([x for _, _, x in out], pa.list_(pa.string()))], names=["conv_id", "formatted", "turns", "trained"])

    return whole.mapInArrow(scan, "conv_id long, formatted string, turns array<struct<role: string, text: string>>, trained array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    read = read_back(pack(given.unionByName(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Twelve and ten characters of control strings and two line breaks a turn; a backslash more for each ``<|`` and the like.
ORACLE = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
