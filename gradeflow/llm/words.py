"""Words and rolling fingerprints of whole Arrow batches, as numpy arrays.

A word's 64-bit fingerprint is a polynomial over its bytes, read off prefix sums modulo 2**64, so no
Python object is made for a word. Runs of words have a polynomial over mixed word fingerprints. Such a
polynomial has strings of 1,024 bytes and more that agree for every odd base, so words of over LONG bytes
get a keyed digest instead. There are two families of fingerprints, with bases of their own: where equality
must hold over a whole corpus, both are compared, 128 bits in all, or the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd bases of the polynomials over bytes and over words, one for each family.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Bytes of a word above which it is digested.
LONG = 64
#: Bytes of text handled in one go; a longer text is a chunk by itself.
CHUNK = 1 << 20

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that end a word: for ``[^\x20\x09-\x0D]+`` and for runs of ASCII letters, digits and all non-ASCII.
BLANKS = _ASCII_SPACE
NON_WORD = np.ones(256, bool)
NON_WORD[0x80:] = False
for _span in ((ord("0"), ord("9")), (ord("a"), ord("z")), (ord("A"), ord("Z"))):
    NON_WORD[_span[0] : _span[1] + 1] = False


def _inverse(x: np.uint64) -> np.uint64:
    """Of an odd number modulo 2**64, by Newton's iteration."""
    value, number = 1, int(x)
    for _ in range(7):
        value = value * (2 - number * value) % (1 << 64)
    return np.uint64(value)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown when a longer text comes."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _inverse(base)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_bytes, _steps = [_Powers(x) for x in BASES], [_Powers(x) for x in STEPS]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some texts in a row: byte ranges in ``data``, fingerprints, and ``first[d] : first[d + 1]`` for text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    prints: np.ndarray
    first: np.ndarray
    rows: range

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def second(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Fingerprints of the second family, of the words from a up to b."""
        starts, ends = self.starts[a:b], self.ends[a:b]
        low = int(starts[0]) if len(starts) else 0
        return byte_prints(self.data[low : int(ends[-1]) if len(ends) else 0], starts - low, ends - low, 1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False, ends: np.ndarray = BLANKS, chunk: int = CHUNK) -> Iterator[Words]:
    """Words of every text, in chunks of whole texts."""
    data, offsets = text_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        yield _words(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at], lower, ends, range(at, upto))
        at = upto


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool, separators: np.ndarray, rows: range) -> Words:
    if lower:
        data = LOWER[data]
    size = len(data)
    inside = np.zeros(size + 2, bool)
    np.logical_not(separators[data], out=inside[1 : size + 1])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < size)]  # a text's end also ends a word
    first[edges] = inside[1:-1][edges]
    last[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, byte_prints(data, starts, ends), np.searchsorted(starts, offsets), rows)


def byte_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Fingerprints of byte ranges."""
    size = len(data)
    up, down = _bytes[family].get(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16, key=b"words").digest()
        out[i] = int.from_bytes(digest[8 * family : 8 * family + 8], "little")
    return out


def run_prints(prints: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Fingerprint of each run of ``n`` consecutive words, by its first word; runs may cross texts."""
    count = len(prints) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = _steps[family].get(len(prints) + 1)
    sums = np.zeros(len(prints) + 1, np.uint64)
    np.cumsum(prints * up[: len(prints)], out=sums[1:])
    return mix((sums[n:] - sums[:count]) * down[:count] + np.uint64(n))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values, by doubling."""
    span, low = 1, x
    while span * 2 <= n:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = n - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
