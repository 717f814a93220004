"""Tails of the normal and Student's t distribution as columns, for tables of results."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Terms of the continued fraction of the incomplete beta function; it converges in far fewer for every finite argument.
TERMS = 400


def beta_ratio(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by Lentz's continued fraction, on the side where it converges fast."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, TERMS):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + k * d) < tiny, tiny, 1 + k * d)
            c = np.where(np.abs(1 + k / c) < tiny, tiny, 1 + k / c)
            out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    value = np.where(x <= 0, 0.0, front * out)
    return np.where(flip, 1 - value, value)


def _column(f, *arguments: Column) -> Column:
    """``f`` of numpy arrays as a column; null where an argument is."""

    @F.arrow_udf(DoubleType())
    def apply(*arrays: pa.Array) -> pa.Array:
        columns = [a.to_numpy(zero_copy_only=False).astype(float) for a in arrays]
        return pa.array(f(*columns), pa.float64(), from_pandas=True)

    return apply(*(a.cast("double") for a in arguments))


def normal_below(z: Column) -> Column:
    """The probability that a standard normal number is below ``z``."""
    half = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])
    return _column(half, z)


def two_sided_t(t: Column, freedom: Column) -> Column:
    """The probability that Student's t with so many degrees of freedom is farther from 0 than ``t``; null without any."""

    def tail(t: np.ndarray, v: np.ndarray) -> np.ndarray:
        v = np.where(v > 0, v, np.nan)
        return np.where(np.isinf(t), 0.0, beta_ratio(np.where(np.isinf(t), 0.0, v / (v + t * t)), v / 2, 0.5))

    return _column(tail, t, freedom)


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation over n rows; null under three rows or without a correlation."""
    certain = F.abs(rho) >= 1
    t = rho * F.sqrt((n - 2) / F.nullif(F.lit(1.0) - rho * rho, F.lit(0.0)))
    return F.when(rho.isNull() | (n < 3), None).when(certain, 0.0).otherwise(two_sided_t(t, n - 2))
