"""Secret scan: known shapes by pattern, random strings by how badly a byte-pair vocabulary compresses them.

Text that people write is covered by long vocabulary entries; a random key breaks into many short ones.
A candidate string with few characters per token is therefore reported, unless it is a number or has the
shape of a known digest. Where the whole string has many, its parts that have few are reported.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that could be a key: base64 and URL-safe characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: md5, sha1, sha224, sha256, sha384 and sha512 in hex; UUIDs; dates and plain numbers.
KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_/+-]+)=*")
#: UUIDs inside a candidate, and what stands between separators.
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
PART = re.compile(r"[^/_-]+")
LEAST_CHARS = 16

TOKENIZERS = "/opt/tokenizers"
CHARS_PER_TOKEN = 2.2

_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes, pattern: str = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""):
    """A tiktoken encoder of a ranks file's content, made once for each Python worker."""
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each known shape, too short ones dropped after matching."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def heaviest(weights: list[float]) -> list[tuple[int, int]]:
    """All maximal runs of weights with a positive sum (Ruzzo and Tompa), as first and one past the last."""
    total, held, over = 0.0, [], []  # begin, end, sum before, sum with
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            while held and held[-1][2] >= new[2]:
                over.append(held.pop())  # can't grow by itself any more
            if not held or held[-1][3] >= new[3]:
                break
            new = (held[-1][0], i + 1, held.pop()[2], total)
        held.append(new)
    out: list[tuple[int, int]] = []
    for a, b, _, _ in sorted(held + over, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:  # else part of a longer one
            out.append((a, b))
    return out


def random_parts(run: str, encode, least: float) -> list[tuple[int, int]]:
    """Neighbouring parts of a run, between '/', '_' and '-', that together have under ``least`` characters a token."""
    known = [m.span() for m in UUID.finditer(run)]
    blocks: list[list[tuple[int, int]]] = [[]]
    for m in PART.finditer(run):
        if KNOWN.fullmatch(m[0]) and not m[0].isdigit() or any(a <= m.start() < b for a, b in known):
            blocks.append([])
        else:
            blocks[-1].append(m.span())
    found = []
    for parts in blocks:
        for i, j in heaviest([least * len(encode(run[max(a - 1, 0) : b])) - (b - max(a - 1, 0)) for a, b in parts]):
            s = run[parts[i][0] : parts[j - 1][1]]
            if len(s) >= LEAST_CHARS and not KNOWN.fullmatch(s) and len(s) < least * len(encode(s)):
                found.append((parts[i][0], parts[j - 1][1]))
    return found


def random_spans(text: str, encode, least: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """Strings of letters and digits with under ``least`` characters a token, or such parts of them."""
    found = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if KNOWN.fullmatch(s):
            continue
        whole = len(s) < least * len(encode(s))
        found += [("random", m.start() + a, m.start() + b) for a, b in ([(0, len(s))] if whole else random_parts(s, encode, least))]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, tokenizers: str = TOKENIZERS, least: float = CHARS_PER_TOKEN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Secrets of every whole text: counts, a digest of the base spans, and all spans.

    A null text counts as empty and has no spans; a null id stays null. Rows are taken one by one, so
    repeated rows give repeated results, and an empty table gives an empty one. Other columns, whatever
    their names, are not read. Spans are in code points with the end exclusive.
    """
    bounded_batches(docs.sparkSession)
    with open(f"{tokenizers}/byte_bpe_50k.tiktoken", "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())  # one fixed file of under 1 MB

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value).encode_ordinary
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, encode, least)
                kinds = [x[0] for x in base]
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr(f"cast({id_column} as long) doc_id", f"{text_column} text").mapInArrow(scan, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
