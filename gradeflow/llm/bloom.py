"""A Bloom filter over 64-bit fingerprints, built by Spark and asked in Python workers.

It only spares work: what it lets through is decided exactly later. Its size follows the number of
fingerprints up to a fixed bound, beyond which more is let through and results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_EACH, HASHES = 32, 4
LEAST_BITS, MOST_BITS = 16, 29


def build(prints: DataFrame, column: str, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits as uint64 words, of the distinct or repeated values of a long column; at most ``2 ** most_bits`` bits reach the driver."""
    n = prints.count()
    log = int(min(most_bits, max(LEAST_BITS, np.ceil(np.log2(max(1, n) * BITS_EACH)))))
    places = F.explode(F.array(*(_place(F.col(column), i, log) for i in range(HASHES))))
    words = prints.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    rows = words.toArrow()
    out = np.zeros(1 << (log - 6), np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def _place(x, i: int, log: int):
    """The i-th place: 29 bits at 11 i, mixed down to ``log`` bits."""
    return F.shiftrightunsigned(x, 11 * i).bitwiseAND(F.lit((1 << log) - 1)) if 11 * i + log <= 64 else F.shiftrightunsigned(x, 64 - log)


def contains(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    log = int(np.log2(len(bits))) + 6
    mask, hit = np.uint64((1 << log) - 1), np.ones(len(prints), bool)
    for i in range(HASHES):
        p = (prints >> np.uint64(11 * i)) & mask if 11 * i + log <= 64 else prints >> np.uint64(64 - log)
        hit &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit
